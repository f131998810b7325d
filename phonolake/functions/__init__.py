"""Column expressions: no joins, no actions, usable on batch and streaming frames alike."""
