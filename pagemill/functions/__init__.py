"""Column expressions; all of them run inside the JVM."""
