"""Expressions over panel leaves: trees, text, checks, and their compilation to DataFrame plans."""
