"""Column builders: field access, predicates, alert text, JSON containment."""
