"""Sources of vectors."""
