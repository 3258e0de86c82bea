"""Column functions: no joins, no actions, usable in batch and streaming."""
