"""Stateful operators, as batch folds and as streaming state."""
