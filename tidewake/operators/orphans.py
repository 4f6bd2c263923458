"""References to records that do not exist (problem 2).

Parent and child keys are tagged and united in long form, grouped by key with one flag per parent table, and only the
groups that lack a flag for some child are kept. A hot key costs nothing there: the aggregation combines on the map
side. The kept groups are written once; rows come back by an equi-join of the slim references (row, key, time) with
them, one row per key. As each side of that join has an exchange of its own, AQE splits it where a missing key is hot.

Cases: null, empty and blank keys are no references; a reference without receipt time is never late; target rows
without receipt time count as there from the start; repeated rows on either side change nothing but the number of
rows out (one per referring row); empty tables give an empty result or make every reference an orphan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.functions.keys import key_kind, norm_key
from tidewake.session import materialise

#: Received "always": earlier than any time stamp.
ALWAYS = -(1 << 62)
FIELDS = ("link_id", "parent_id")


def references(comments: DataFrame) -> DataFrame:
    """One row per comment row and filled reference: ``row_id, ref_field, key, kind (t1, t3, any), at, created_utc``."""
    refs = F.array(*[F.struct(F.lit(f).alias("ref_field"), norm_key(F.col(f)).alias("key"), F.coalesce(key_kind(F.col(f)), F.lit("t3" if f == "link_id" else "any")).alias("kind")) for f in FIELDS])
    return (
        comments.select("row_id", F.unix_micros("received_at").alias("at"), "created_utc", F.inline(refs))
        .where(F.col("key").isNotNull())
    )


def _parents(df: DataFrame, kind: str, at: Column) -> DataFrame:
    return df.select(norm_key(F.col("id")).alias("key"), F.lit(kind).alias("kind"), F.coalesce(at, F.lit(ALWAYS)).alias("first"))


def orphan_keys(refs: DataFrame, comments: DataFrame, posts: DataFrame, threads: DataFrame, removals: DataFrame) -> DataFrame:
    """Per key with at least one orphan child: when a comment (``t1_first``) and a post or thread (``t3_first``) of that
    key first came, and whether either was removed."""
    none = F.lit(None).cast("long")
    parents = (
        _parents(comments, "t1", F.unix_micros("received_at"))
        .unionByName(_parents(posts, "t3", F.unix_micros("received_at")))
        .unionByName(_parents(threads, "t3", F.lit(ALWAYS)))
        .select("key", F.concat(F.lit("p"), "kind").alias("tag"), F.col("first").alias("at"))
    )
    gone = removals.select(norm_key(F.col("fullname")).alias("key"), F.concat(F.lit("r"), key_kind(F.col("fullname"))).alias("tag"), none.alias("at"))
    children = refs.select("key", F.concat(F.lit("c"), "kind").alias("tag"), F.coalesce("at", F.lit(ALWAYS)).alias("at"))
    tagged = parents.unionByName(gone).unionByName(children).where(F.col("key").isNotNull())

    def first(tag: str) -> Column:
        return F.min(F.when(F.col("tag") == tag, F.col("at")))

    def has(tag: str) -> Column:
        return F.coalesce(F.max(F.col("tag") == tag), F.lit(False))

    g = tagged.groupBy("key").agg(
        first("pt1").alias("t1_first"), first("pt3").alias("t3_first"), has("rt1").alias("t1_gone"), has("rt3").alias("t3_gone"),
        first("ct1").alias("c1"), first("ct3").alias("c3"), first("cany").alias("cany"), has("ct1").alias("h1"), has("ct3").alias("h3"), has("cany").alias("hany"),
    )
    either = F.least("t1_first", "t3_first")

    def lacks(there: Column, child: str, at: str) -> Column:
        # a child without a time has the earliest one; whether it really is an orphan is decided by row
        return F.col(child) & (there.isNull() | (F.col(at) < there))

    return g.where(lacks(F.col("t1_first"), "h1", "c1") | lacks(F.col("t3_first"), "h3", "c3") | lacks(either, "hany", "cany")).select("key", "t1_first", "t3_first", "t1_gone", "t3_gone")


def orphan_references(comments: DataFrame, posts: DataFrame, threads: DataFrame, removals: DataFrame) -> DataFrame:
    """``row_id, ref_field, state, created_utc`` of every reference whose key finds no record received by then."""
    refs = references(comments)
    keys = materialise(orphan_keys(refs, comments, posts, threads, removals))
    kind = F.col("kind")
    first = F.when(kind == "t1", F.col("t1_first")).when(kind == "t3", F.col("t3_first")).otherwise(F.least("t1_first", "t3_first"))
    gone = F.when(kind == "t1", F.col("t1_gone")).when(kind == "t3", F.col("t3_gone")).otherwise(F.col("t1_gone") | F.col("t3_gone"))
    return (
        refs.join(keys, "key")
        .withColumns({"first": first, "gone": gone})
        .where(F.col("first").isNull() | (F.col("first") > F.col("at")))
        .select("row_id", "ref_field", F.when(F.col("first").isNotNull(), "late").when(F.col("gone"), "deleted").otherwise("missing").alias("state"), F.col("created_utc"), F.col("kind").alias("target"))
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table referred to, field, state and month of the referring row (null month where it has no time)."""
    month = F.date_format(F.timestamp_seconds("created_utc"), "yyyy-MM")
    return orphans.groupBy("target", "ref_field", "state", month.alias("period")).agg(F.count(F.lit(1)).alias("n_orphans"))
