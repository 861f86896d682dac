"""millrace: a Spark-first SQL and lakehouse engine."""

__version__ = "0.1.0"
