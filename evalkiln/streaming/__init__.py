"""Streaming parts of the engine."""
