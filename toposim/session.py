"""Spark session defaults used by tests, bench and examples.

On a cluster the caller's session is used as-is; these defaults only
fill what is unset.  The settings that matter at scale:

* AQE on, with skew-join splitting and partition coalescing, so hot
  keys in pair / token tables are split at run time.
* Arrow on, so the few pandas UDF kernels move column batches.
* ``spark.checkpoint.dir`` is read from the session; a private folder
  under /tmp is set only when nothing is configured and the master is
  local (one machine).  On a cluster a missing setting is an error.
"""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.ansi.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "toposim") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions",
                             str(shuffle_partitions or int(cpus)))
    builder = builder.config("spark.driver.memory", os.environ.get("TOPOSIM_DRIVER_MEM", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    Reads ``spark.checkpoint.dir``; only when it is unset and the master
    is local a fresh folder under /tmp is created and registered.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="toposim-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def materialize(df, label: str = "stage"):
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    read it back.

    This cuts the plan (Catalyst re-plans from a plain scan, with column
    pruning and filter push-down) and survives executor loss, and unlike
    ``Dataset.checkpoint()`` on an unpersisted plan it computes the data
    only once.
    """
    import uuid

    spark = df.sparkSession
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/toposim-{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def spread(df):
    """``df`` dealt evenly over the cores.

    A scan has as many tasks as its file has row groups, and a broadcast
    join keeps them, so a small file would leave all later row-local work
    to one or two tasks."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Workers unpickle functions by module name, so they need the package
    wherever the driver was started; ``addPyFile`` hands them a zip.
    """
    sc = spark.sparkContext
    if getattr(sc, "_toposim_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="toposim-pkg-"), "toposim_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._toposim_shipped = True
