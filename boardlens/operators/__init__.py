"""Operators of the board-log engine."""
