"""A PySpark-native analytics engine for catalogue, activity and document data."""
