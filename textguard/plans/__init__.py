"""Composite entry points built from the operators."""
