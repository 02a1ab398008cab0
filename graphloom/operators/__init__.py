"""DataFrame operators: traversal, search, roll-up, build."""
