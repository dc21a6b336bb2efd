"""Factorisations, sums, checks and generators over matrices."""
