"""Build, verify, package and score text-to-SQL corpora as Spark jobs."""

__version__ = "0.1.0"
