"""Whole gradings built from the operators."""
