"""Column functions: text, identity, geometry, paths."""
