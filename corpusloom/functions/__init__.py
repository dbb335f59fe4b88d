"""Column expressions: text, predicates, scalars."""
