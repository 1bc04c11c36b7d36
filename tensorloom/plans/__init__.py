"""Iterative programs over the operators."""
