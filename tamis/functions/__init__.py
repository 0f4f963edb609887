"""Column expressions shared by every operator; all of them are JVM-side."""
