"""Functions of the plate analytics library."""
