"""Scalar parsing and column functions."""
