"""Functions that take and return Spark columns."""
