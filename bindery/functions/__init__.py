"""Column expressions; everything here runs JVM-side inside code generation."""
