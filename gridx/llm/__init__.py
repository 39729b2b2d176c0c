"""Operators for training-data pipelines over documents. Nothing outside this subpackage imports it."""
