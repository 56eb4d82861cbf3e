"""skein: code-corpus and training-data analytics, written as Spark jobs."""

__version__ = "0.1.0"
