"""Operators for training-data pipelines.

Nothing outside this subpackage imports it; it can be deleted as a whole."""
