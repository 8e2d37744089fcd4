"""Survey-aware analytics on Spark."""
