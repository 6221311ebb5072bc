"""Operators over the long sparse matrix and its axes."""
