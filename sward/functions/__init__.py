"""Column expressions: everything here stays on the JVM and inside code generation."""
