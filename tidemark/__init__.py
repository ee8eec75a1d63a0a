"""A Spark-native engine for causal studies: declared designs, typed questions, targeted estimates."""

__version__ = "0.1.0"
