"""Column helpers: predicates, column classes, numeric text."""
