"""A PySpark-native analytics engine for panels of daily bars."""
