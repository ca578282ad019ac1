"""Writing, hierarchies, receipts and folds."""
