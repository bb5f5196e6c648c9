"""mnemolith: a Spark-native analytics engine over logs of short text records."""

__version__ = "0.1.0"
