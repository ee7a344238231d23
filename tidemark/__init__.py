"""tidemark: a Spark-first engine for curating and auditing time-stamped text observations."""

__version__ = "0.1.0"
