"""DataFrame operators: chunking, embedding, collection, kNN, answering, metrics, repair, reports."""
