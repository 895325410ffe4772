"""Cloneweave: a PySpark-native engine for annotating antibody and T-cell-receptor reads."""

__version__ = "0.1.0"
