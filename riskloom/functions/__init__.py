"""Column functions: scalars of the transaction model, and text for people."""
