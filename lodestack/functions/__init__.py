"""Column expressions of the catalogue; all run inside the JVM."""
