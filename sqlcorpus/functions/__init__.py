"""Column -> Column functions: labels, SQL text, identifiers, cells, keys."""
