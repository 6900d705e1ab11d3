"""Column builders: scores, predicates, generators."""
