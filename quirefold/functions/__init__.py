"""Column expressions: text, number and date predicates, geometry."""
