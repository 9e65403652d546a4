"""Functions of columns: text, scores, statistics and arrays."""
