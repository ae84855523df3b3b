"""lexspark: a PySpark-native engine for enriching, storing and searching legal documents."""

__version__ = "0.1.0"
