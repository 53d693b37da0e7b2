"""PySpark-native analytics over synthetic-aperture-radar scenes and tables."""
