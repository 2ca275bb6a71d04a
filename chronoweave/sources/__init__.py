"""Stores, front ends and sinks."""
