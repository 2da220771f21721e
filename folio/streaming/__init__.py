"""Structured Streaming form of the running state."""
