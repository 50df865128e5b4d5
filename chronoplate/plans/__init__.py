"""Plans of the plate analytics library."""
