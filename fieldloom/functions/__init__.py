"""Column expressions: identifiers, vectors, dates, places, units."""
