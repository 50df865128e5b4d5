"""Sources of the plate analytics library."""
