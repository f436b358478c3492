"""tidewell: a Spark-first full-text indexing and search engine."""

__version__ = "0.1.0"
