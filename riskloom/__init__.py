"""A PySpark engine for scoring card transactions, with operators for training data beside it."""
