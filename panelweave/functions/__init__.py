"""Column-level helpers; everything here stays inside JVM expressions."""
