"""Expressions: Morton keys, mode orders, vectors as arrays."""
