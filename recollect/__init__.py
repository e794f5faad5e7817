"""recollect: a PySpark-native analytics engine for note, diary and graph memory data."""

__version__ = "0.1.0"
