"""quern: a Spark-first semantic diff engine for versioned typed graphs."""

__version__ = "0.1.0"
