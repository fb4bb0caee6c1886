"""PySpark-native analytics for published web content."""
