"""lodestrata: a PySpark-native engine for entity records, text and training-data pipelines."""

__version__ = "0.1.0"
