"""Column functions: identity, paths, text, scoring."""
