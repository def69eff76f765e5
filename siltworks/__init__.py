"""Corpus analytics on Spark: profiling, auditing, scanning, scoring and reshaping collections of code and text."""

__version__ = "0.1.0"
