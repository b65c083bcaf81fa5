"""tabsmith: tabular profiling, transform steps, splits, metrics and model runs on Spark.

Every operator takes and returns Spark DataFrames and is built from DataFrame / SQL
expressions, so Catalyst plans the work and the cluster executes it.
"""

__version__ = "0.1.0"

SPLIT_COL = "__ml_split__"
