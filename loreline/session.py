"""Session settings the library relies on, and the folder for what is read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_held: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read and write.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset (tests, a
    laptop) a temporary folder is made once and set on the context.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="loreline-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable: Spark reads the setting only on request."""
    where = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own part of the shared folder.

    That part is removed by ``release``, at the latest when the driver's Python ends.
    """
    root = f"{shared_dir(spark)}/loreline-{spark.sparkContext.applicationId}"
    if root not in _held:
        _held[root] = spark
    return f"{root}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession | None = None) -> None:
    """Remove what ``materialise`` and ``scratch_path`` left, of all sessions by default.
    DataFrames that were built on it can't be read afterwards."""
    for root, s in list(_held.items()):
        if spark is None or s.sparkContext is spark.sparkContext:
            del _held[root]
            try:
                fs, p = file_system(s, root)
                fs.delete(p, True)
            except Exception:  # the JVM has ended before; the cluster's own clean-up is left
                pass


atexit.register(release)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once in the shared folder and read it back: the lineage is cut and
    survives the loss of executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
