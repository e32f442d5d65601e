"""quern: a PySpark-native analytics engine for record identification, ranking and corpus preparation."""

__version__ = "0.1.0"
