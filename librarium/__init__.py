"""librarium: a Spark-native engine for libraries of documents."""

__version__ = "0.1.0"
