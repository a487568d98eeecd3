"""confluo: a PySpark-native engine for record integration, entity resolution and event discovery."""

__version__ = "0.1.0"
