"""A PySpark-native analytics engine for streams of short news messages."""
