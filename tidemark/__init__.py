"""A PySpark-native engine for replicated, local-first data at scale."""
