"""Column-level functions: text, hashing, vectors."""
