"""Options and run records."""
