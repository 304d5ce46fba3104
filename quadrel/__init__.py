"""A Spark engine for geospatial tiles: pixels, features and tiles as relations."""
