"""Scans and sinks: corpora, QA datasets, result tables."""
