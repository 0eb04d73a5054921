"""leafmill: a Spark-native engine for document trees, canonical tables and questions over them."""

__version__ = "0.1.0"
