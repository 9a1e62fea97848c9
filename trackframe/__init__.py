"""Object-tracking analytics on Spark."""
