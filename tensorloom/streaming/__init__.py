"""Incremental tensors; an extension."""
