"""Column expressions on reads; all run in the JVM."""
