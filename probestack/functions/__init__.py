"""Column functions: vectors, text and times; all stay in the JVM."""
