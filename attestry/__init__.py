"""PySpark-native analytics for identity-risk data."""
