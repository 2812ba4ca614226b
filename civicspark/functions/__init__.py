"""Column expressions: predicates, scalars, geometry, hashing."""
