"""textlode: a Spark-native full-text retrieval and ranking engine."""

__version__ = "0.1.0"
