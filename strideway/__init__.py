"""Street-network analytics on Spark."""
