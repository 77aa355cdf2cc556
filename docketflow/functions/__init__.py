"""Column expressions: text predicates, keys and times."""
