"""braidwork: a Spark-first engine for version-history and evaluation tables."""

__version__ = "0.1.0"
