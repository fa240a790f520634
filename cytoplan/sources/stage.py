"""Stage boundaries: a result that several later steps read is written once to the shared folder and read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Deletes the shuffle files of a plan once it has been run.
CLEANS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: list[str] = []
#: Staged frames whose files are still there.
_live: list[DataFrame] = []


def is_cluster(spark: SparkSession) -> bool:
    """Whether executors are other processes than the driver."""
    master = spark.sparkContext.master
    return not master.startswith("local") or master.startswith("local-cluster")


def folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, which executors share.

    Where that is unset a temporary folder does in local mode only: on a cluster each machine would see its own, and rows be lost.
    That a ``file:`` path is a mounted share cannot be told from here; it is taken as the setting says.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if is_cluster(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="cytoplan-"))
        base = _own[0]
    return f"{base.rstrip('/')}/cytoplan/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` by way of Parquet: later plans start from a scan, and a lost executor costs no recomputation.

    Nothing reads the plan's shuffle files from then on, so they are deleted: what lies on the disks is that of one plan, not of all.
    """
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    before = spark.conf.get(CLEANS, None)
    spark.conf.set(CLEANS, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANS)
        else:
            spark.conf.set(CLEANS, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path  # type: ignore[attr-defined]
    _live.append(out)
    return out


@contextmanager
def stages() -> Iterator[None]:
    """What is staged within is deleted at the end, also after an error: for commands whose results are written by then."""
    mark = len(_live)
    try:
        yield
    finally:
        discard(*_live[mark:])


def discard(*frames: DataFrame) -> None:
    """Delete the files of staged frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "staged_at", None)
        if path:
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
            _live[:] = [other for other in _live if other is not df]
