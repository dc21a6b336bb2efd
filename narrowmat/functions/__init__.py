"""Column expressions (JVM side) and numpy block kernels (inside tasks)."""
