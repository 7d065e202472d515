"""Package streaming of the tree-inventory engine."""
