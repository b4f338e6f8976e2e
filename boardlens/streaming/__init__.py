"""Streaming of the board-log engine."""
