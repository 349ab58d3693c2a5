"""velith: a Spark-native engine for retrieval analytics over document corpora."""

__version__ = "0.1.0"
