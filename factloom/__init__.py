"""A PySpark-native analytics engine for property-graph facts about code and text."""
