"""A PySpark-native engine that stress-tests quantitative claims over panels of dates and assets."""
