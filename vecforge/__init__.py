"""A PySpark-native engine for key-to-vector analytics: lookups, pooling, table maintenance, caches."""
