"""tidemark: a Spark-native engine for preparing and scoring object-detection datasets."""

__version__ = "0.1.0"
