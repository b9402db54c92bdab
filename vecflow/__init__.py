"""vecflow: a PySpark-native pipeline for large blocks of 3-D (and wider)
vectors, and analytics over its own run reports.

Everything is expressed as DataFrame plans; see README.md for the map of
"""

from vecflow.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
