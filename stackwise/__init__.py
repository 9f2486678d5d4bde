"""stackwise: a PySpark-native catalog analytics engine."""
