"""probestack: PySpark-native analytics over layered representations."""
