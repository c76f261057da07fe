"""revlens — review analytics on Spark DataFrames.

Every operator is a pure function ``f(DataFrame, ...) -> DataFrame`` built
from Spark SQL column expressions, windows, joins and aggregations, so the
same code runs on a laptop sample and on a cluster.
"""

__all__ = ["session", "sources", "functions", "operators", "plans", "streaming"]
