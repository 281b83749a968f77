"""Column expressions: predicates, scalar functions and aggregates. All are built-in functions, so plans stay in the JVM."""
