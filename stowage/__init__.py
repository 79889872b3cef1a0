"""A PySpark-native analytics engine for file inventories: inventory DataFrame in, plan DataFrame out."""
