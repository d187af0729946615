"""strataforge: analytics over semi-structured engineering records, on Spark."""

__version__ = "0.1.0"
