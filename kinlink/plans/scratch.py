"""Cutting lineage: intermediate tables in the shared checkpoint folder.

A table written once to reliable storage survives the loss of any executor and is
never computed twice.  The folder is the session's ``spark.checkpoint.dir``; where that is unset a local
master (tests, a laptop) gets a temporary folder, and a cluster an error, since its executors share
no local folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Most bytes of an Arrow batch that goes to Python, unless the session sets a bound of its own: both sides hold
#: a few of them a task.
ARROW_BYTES = 4 << 20
_ARROW_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def scratch_dir(spark: SparkSession) -> str:
    """One folder per Spark application below the checkpoint folder."""
    sc = spark.sparkContext
    if not hasattr(sc, "_kinlink_scratch"):
        base = spark.conf.get("spark.checkpoint.dir", None) or sc._conf.get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="kinlink-")
        root = f"{base.rstrip('/')}/kinlink-{uuid.uuid4().hex}"
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        sc._kinlink_scratch = root
    return sc._kinlink_scratch


class Kept:
    """A written table; ``drop()`` frees its files once nothing reads them."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{scratch_dir(self.spark)}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        _kept(self.spark).append(self)

    def drop(self) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        _kept(self.spark).remove(self)


def _kept(spark: SparkSession) -> list[Kept]:
    """The tables of this application that weren't freed yet, oldest first."""
    sc = spark.sparkContext
    if not hasattr(sc, "_kinlink_kept"):
        sc._kinlink_kept = []
    return sc._kinlink_kept


def mark(spark: SparkSession) -> int:
    """A point in time for ``free``."""
    return len(_kept(spark))


def free(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Delete the tables kept from one ``mark`` to another (or now).  What still reads them can't be run any more."""
    for k in _kept(spark)[since:until]:
        k.drop()


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the scratch folder and return the DataFrame that reads it."""
    return Kept(df, name).df


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, for functions that run in Python there, and bound their batches."""
    sc = spark.sparkContext
    if _ARROW_SETTING not in spark.conf.getAll:
        spark.conf.set(_ARROW_SETTING, str(ARROW_BYTES))
    if hasattr(sc, "_kinlink_shipped"):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="kinlink-code-"), "kinlink.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(_PACKAGE):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("kinlink", os.path.relpath(full, _PACKAGE)))
    sc.addPyFile(target)
    sc._kinlink_shipped = True


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by ``key`` to all cores, if its files give fewer tasks: a small file is a single one, whatever is made of its rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def shuffle_partitions(spark: SparkSession, rows: int = 0, rows_per_task: int = 2_000_000) -> int:
    """The session's shuffle partitions, or more if that many rows would overfill them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_task))
