"""weftline: Spark-native preparation and analysis of mixed-language corpora."""

__version__ = "0.1.0"
