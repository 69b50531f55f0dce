"""folioflow: a PySpark-native recommendation, digest and text-data engine."""
