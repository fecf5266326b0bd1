"""lanternq: a Spark-native engine for evaluation, retrieval and routing analytics over help-desk text."""

__version__ = "0.1.0"
