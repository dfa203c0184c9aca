"""Column functions: geometry, tags, text, time, and the cost model."""
