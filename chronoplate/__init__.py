"""Deep-time plate analytics on Spark."""
