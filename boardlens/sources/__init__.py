"""Sources of the board-log engine."""
