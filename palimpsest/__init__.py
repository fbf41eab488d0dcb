"""palimpsest: a Spark-native engine for the analytics of an agent's long-term memory."""

__version__ = "0.1.0"
