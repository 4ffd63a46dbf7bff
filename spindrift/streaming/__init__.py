"""Stateful operators on streams and their batch twins."""
