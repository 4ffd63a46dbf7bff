"""Spark transformations, one function per operator."""
