"""notelake: a Spark-native analytics engine for linked document collections."""

__version__ = "0.1.0"
