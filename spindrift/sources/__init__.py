"""Readers and writers of array files."""
