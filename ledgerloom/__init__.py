"""ledgerloom: a Spark-native engine for enriching and labelling transaction text."""

__version__ = "0.1.0"
