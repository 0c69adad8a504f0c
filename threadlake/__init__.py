"""threadlake: a PySpark-native engine over team-chat archives."""

__version__ = "0.1.0"
