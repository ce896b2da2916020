"""siltworks: a Spark-native engine for tables of fetched web content."""

__version__ = "0.1.0"
