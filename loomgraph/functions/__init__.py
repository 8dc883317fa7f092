"""Column functions and plain text functions of the engine."""
