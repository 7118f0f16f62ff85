"""A PySpark-native engine for versioned event streams."""
