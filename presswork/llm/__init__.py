"""Operators for building training corpora from the engine's tables. Nothing else in the package imports this."""
