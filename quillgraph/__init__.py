"""PySpark-native engine for text knowledge graphs and retrieval."""
