"""Column functions: text, vectors, URLs and HTML."""
