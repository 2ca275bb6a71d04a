"""Structured Streaming ingestion and sessions."""
