"""Column functions: vectors, texts, timestamps, HTML."""
