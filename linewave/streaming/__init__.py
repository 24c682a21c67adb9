"""Continuous runs over arriving images."""
