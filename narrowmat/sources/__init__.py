"""Readers, matrix views and writers."""
