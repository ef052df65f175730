"""setscope: set-membership analytics on Spark.

Every operator takes and returns DataFrames; the heavy lifting is Spark SQL
(joins, aggregates, windows) or MLlib estimators, so the same code runs on
``local[*]`` and on a cluster.
"""

from setscope.options import Options

__all__ = ["Options"]
