"""PySpark-native engine for log diagnosis, document retrieval and answer verification."""
