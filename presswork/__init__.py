"""presswork: a PySpark-native engine for building and analysing large multilingual news corpora."""

__version__ = "0.1.0"
