"""A PySpark-native analytics engine for media asset catalogs."""
