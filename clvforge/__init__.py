"""clvforge: customer-value analytics as composable Spark DataFrame operators.

Every public operator takes DataFrames and returns a DataFrame, so pipelines are
built with ``df.transform(op)`` and optimised by Catalyst as one plan.
"""

from clvforge.session import get_spark, durable_cut, checkpoint_dir

__all__ = ["get_spark", "durable_cut", "checkpoint_dir"]
__version__ = "0.1.0"
