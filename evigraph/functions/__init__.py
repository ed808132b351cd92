"""Column expressions: identifiers, links, text units, numbers, model answers."""
