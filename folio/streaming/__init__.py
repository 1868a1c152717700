"""Structured Streaming counterparts of the batch sources."""
