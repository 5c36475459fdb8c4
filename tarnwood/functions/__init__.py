"""Column functions: vectors, scores, texts and formats."""
