"""Colloquy: transcript and study-note analytics on Spark DataFrames."""

__version__ = "0.1.0"
