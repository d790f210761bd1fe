"""Column expressions: tags, text, geometry, projection and rings."""
