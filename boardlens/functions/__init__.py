"""Functions of the board-log engine."""
