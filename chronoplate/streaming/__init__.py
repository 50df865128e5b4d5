"""Streaming of the plate analytics library."""
