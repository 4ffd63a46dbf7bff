"""Spark-native numeric-array, fingerprint-search and corpus analytics."""
