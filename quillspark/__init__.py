"""Quillspark: a PySpark-native evidence engine and training-data toolkit."""
