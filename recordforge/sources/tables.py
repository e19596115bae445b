"""Reading the given tables and keeping intermediate results on shared storage."""

from __future__ import annotations

import contextlib
import math
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


#: Rows of a few numbers that are no work for more than one task.
TASK_ROWS = 100_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: `spark.checkpoint.dir`.

    Only in local mode (a test, a laptop), where the session names none, a local
    temporary folder is set for it; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        found = context._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        context.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a result to the shared folder as Parquet and reads it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    for held in _kept:
        held.append(path)
    return out


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """The same rows in no more tasks than `rows` rows need, and at least two for each core.

    For results of a shuffle: a step on a small table takes a few tasks and files, however many
    partitions a shuffle has. `rows` is known to be as many as there are, or more; where
    that asks for more tasks than there are partitions, nothing changes. Rows of one
    partition stay together.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(2 * cores, math.ceil(rows / TASK_ROWS)))


#: Open `scratch` blocks, each the paths written within it.
_kept: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end what `materialise` wrote within; remove from the list what is to stay."""
    paths: list[str] = []
    _kept.append(paths)
    try:
        yield paths
    finally:
        _kept.remove(paths)
        for path in paths:
            _delete(spark, path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialised result that nothing reads any more."""
    if path := getattr(df, "_scratch", None):
        _delete(df.sparkSession, path)


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    at, files = _at(spark, path)
    files.delete(at, True)


def make_folder(spark: SparkSession, path: str) -> None:
    at, files = _at(spark, path)
    files.mkdirs(at)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Renames a folder, so that all it holds appears in its new place at once."""
    at, files = _at(spark, path)
    if not files.rename(at, _at(spark, to)[0]):
        raise OSError(f"{path} could not be moved to {to}")
