"""toposim — place-record linkage as Spark DataFrame / SQL / ML jobs.

Every public operator takes DataFrames (plus column names or small
parameter values) and returns a DataFrame.  Nothing is collected to
the driver except one-row scalars and fitted models.
"""

from toposim.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
