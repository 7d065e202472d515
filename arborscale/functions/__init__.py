"""Package functions of the tree-inventory engine."""
