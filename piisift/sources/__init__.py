"""Sources: path selection predicates, the distributed file lister, text extraction."""
