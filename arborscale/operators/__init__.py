"""Package operators of the tree-inventory engine."""
