"""Logical plans: grouping, folding, serialization."""
