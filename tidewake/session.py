"""Session, table access and the few physical helpers every operator shares."""

from __future__ import annotations

import atexit
import os
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most this many rows may be broadcast; it is counted (with a limit) before the hint is given.
SMALL_ROWS = 100_000


def build_session(app: str = "tidewake", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; the cluster's own settings are left alone."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``directory`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


#: Folders written between steps by this process, deleted when it ends.
_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir`` of the session; on a single machine one of our own if unset."""
    d = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = "file://" + os.path.join(os.environ.get("TMPDIR", "/tmp"), "tidewake-shared")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def scratch(spark: SparkSession, name: str = "step") -> str:
    """A new folder of this process in the shared one."""
    path = f"{shared_dir(spark)}/tidewake-{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


@atexit.register
def clean_up() -> None:
    """Delete what this process wrote between steps; results still to be computed from it are lost."""
    while _WRITTEN:
        path, spark = _WRITTEN.popitem()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is gone, and with it the way to the folder
            return


def materialise(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared folder, in folders of equal ``by``, and read it back.

    Executors may be lost afterwards without recomputing what led here. The schema is kept as it is.
    """
    path = scratch(df.sparkSession)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than that many."""
    return df.limit(rows + 1).count() <= rows


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", rows: int = SMALL_ROWS) -> DataFrame:
    """Join to a dimension: broadcast only if it was counted to be small, else a shuffled join that AQE splits where skewed."""
    return left.join(F.broadcast(right) if fits(right, rows) else right, on, how)


def spread(df: DataFrame, key: str | Column) -> DataFrame:
    """Rows over at least as many partitions as there are cores, for CPU-heavy Python over few, large input splits.

    Only acts when the scan has fewer splits than cores, so at scale no text is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores, key)
