"""Tesserae: a Spark-native engine for collections of short text memories."""

__version__ = "0.1.0"
