"""Streams of vectors."""
