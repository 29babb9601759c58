"""A PySpark-native engine for rule-based analytics."""
