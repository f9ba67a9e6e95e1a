"""Column-expression building blocks shared by operators (all JVM-side, codegen-friendly)."""
