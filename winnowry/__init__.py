"""winnowry: a Spark-native engine that turns web pages into clean text."""

__version__ = "0.1.0"
