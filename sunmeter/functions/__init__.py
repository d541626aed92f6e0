"""Column expressions and the wire format."""
