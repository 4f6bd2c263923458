"""The raw archive: records by data set and UTC month, append-only, as compressed JSON lines or Parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewake.functions.calendars import month_of
from tidewake.functions.text import is_withdrawn
from tidewake.session import materialise

FORMATS = {"json": {"compression": "gzip"}, "parquet": {}}


def append(records: DataFrame, root: str, dataset: str, fmt: str = "json") -> int:
    """Add records under their month; returns how many. Rows are not shuffled; each task writes the months it meets."""
    seen = Observation()
    out = records.withColumn("month", month_of(F.col("created_utc"))).observe(seen, F.count(F.lit(1)).alias("n"))
    out.write.mode("append").partitionBy("month").format(fmt).options(**FORMATS[fmt]).save(f"{root}/{dataset}")
    return int(seen.get["n"])


def read(spark: SparkSession, root: str, dataset: str, schema: StructType, month: str | None = None, fmt: str = "json") -> DataFrame:
    """Records of a data set, of one month if given (only its folder is read); empty if there is none."""
    full = StructType([*schema.fields]).add("month", "string")
    try:
        df = spark.read.schema(full).format(fmt).load(f"{root}/{dataset}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], full)
    return df if month is None else df.where(F.col("month") == month)


def months(archive: DataFrame) -> DataFrame:
    """The months there are, sorted; answered from the folder names."""
    return archive.select("month").distinct().orderBy("month")


def purge(spark: SparkSession, root: str, dataset: str, schema: StructType, live_ids: DataFrame | None = None, fmt: str = "json") -> dict[str, int]:
    """Rewrite the months that hold withdrawn records, or ids that are no longer live, without them.

    Months without any stay untouched. What is kept is first written elsewhere, as a folder can't be read and replaced
    at once; then only those months are overwritten. Returns what was dropped by month.
    """
    df = read(spark, root, dataset, schema, fmt=fmt)
    gone = is_withdrawn(*[F.col(c) for c in ("body", "selftext") if c in df.columns])
    if live_ids is not None:
        df = df.join(live_ids.select("id", F.lit(True).alias("_live")).distinct(), "id", "left")
        gone = gone | F.col("_live").isNull()
    dropped = {r["month"]: r["n"] for r in df.where(gone).groupBy("month").agg(F.count(F.lit(1)).alias("n")).collect()}
    if dropped:
        kept = materialise(df.where(~gone & F.col("month").isin(*dropped)).select(*[f.name for f in schema.fields], "month"))
        empty = set(dropped) - {r["month"] for r in kept.select("month").distinct().collect()}
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").format(fmt).options(**FORMATS[fmt]).save(f"{root}/{dataset}")
        for m in empty:  # nothing of the month is left: its folder goes
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{dataset}/month={m}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return dropped
