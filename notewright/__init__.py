"""notewright: a PySpark-native engine for collections of clinical notes and encounters."""

__version__ = "0.1.0"
