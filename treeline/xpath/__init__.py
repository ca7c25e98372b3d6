"""xpath of the engine."""
