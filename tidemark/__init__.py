"""Spark-native ordered multi-version key-value analytics."""

# The version of the interface.
MAJOR, MINOR = 1, 23
__version__ = f"{MAJOR}.{MINOR}"
