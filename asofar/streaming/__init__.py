"""Tile maintenance by Structured Streaming."""
