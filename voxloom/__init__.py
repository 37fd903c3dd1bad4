"""voxloom: a Spark-native engine for time-coded recordings and file collections."""

__version__ = "0.1.0"
