"""Package sources of the tree-inventory engine."""
