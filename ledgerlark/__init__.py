"""A Spark engine for verified question answering over document collections."""

__version__ = "0.1.0"
