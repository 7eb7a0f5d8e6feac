"""Source code treated as data: a PySpark-native analytics engine."""
