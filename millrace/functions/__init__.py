"""Column functions whose semantics Spark's own don't have."""
