"""Streams of artifacts into the same snapshot functions."""
