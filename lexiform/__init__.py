"""Text-encoder analytics and training-data operators on PySpark."""

__version__ = "0.3.1"
