"""A PySpark-native engine for typed, confidence-scored property graphs."""
