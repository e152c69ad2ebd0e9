"""Scalar functions and the function registry."""
