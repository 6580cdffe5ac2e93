"""tidemark: a PySpark-native analytics engine for event-level star schemas."""
