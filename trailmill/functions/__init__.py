"""Functions of the trajectory engine."""
