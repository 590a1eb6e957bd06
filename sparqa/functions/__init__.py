"""Column-expression building blocks (strip, tokens, hash vectors, context parsing)."""
