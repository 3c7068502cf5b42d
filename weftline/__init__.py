"""weftline: a PySpark-native engine for corpora, relations and factor models."""
