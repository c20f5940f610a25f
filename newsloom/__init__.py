"""newsloom: a PySpark-native engine for news and web-document intelligence."""

__version__ = "0.1.0"
