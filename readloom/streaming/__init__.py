"""Lanes that arrive as a stream."""
