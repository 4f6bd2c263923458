"""Schemas that drift between files (problem 1).

1. Header of every file, in parallel: which top-level names its JSON records use, the JSON types of their values and a
   constant-size profile of their content (classes, lengths, numbers, min-hash). One shuffle, combined on the map side.
2. Every file is laid beside the preceding file of its feed by one aggregation over (feed, file, name).
3. A name that went and a name that came are one renamed field if their content agrees: shared values, or the same
   shape where values are all different, or numbers that may come from one distribution, or times that fill as much of
   their files. That both are flags, or both are nested, is no evidence. Best pairs first; a name is used once.
4. Types are folded through a promotion lattice and records cast to the union schema, names resolved along renames.

Cases: null or unreadable payloads and those that are no object have no names; a file without any readable record is
passed over; a name whose values are all null is there, without types, and is no retyping; repeated records change
nothing; names in other case are other names; an empty table gives no changes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions.instants import plain_number
from tidewake.functions.keys import strip
from tidewake.session import materialise

#: Min-hash functions of a profile; the least score of a renamed pair.
HASHES, LEAST = 32, 0.5
#: Standard errors by which two samples of one distribution may differ.
SIGMAS = 4.5
#: JSON types, each a bit of a set.
TYPES = ("array", "boolean", "integer", "number", "object", "string")
CLASSES = ("time", "num", "bool", "struct", "word", "text")

#: Promotion lattice: the least type that holds both. A type is below ``string``; whatever else meets is kept as JSON.
PROMOTION = {frozenset(p): to for p, to in {("integer", "number"): "number", ("integer", "string"): "string", ("number", "string"): "string", ("boolean", "string"): "string", ("boolean", "integer"): "integer", ("boolean", "number"): "number"}.items()}


def promote(types: list[str]) -> str | None:
    """The union of JSON types."""
    out: str | None = None
    for t in types:
        out = t if out is None or out == t else PROMOTION.get(frozenset((out, t)), "json")
    return out


def values(lines: DataFrame) -> DataFrame:
    """One row per record and top-level name: ``feed, file_seq, file_name, name, type, content, class``."""
    spark = lines.sparkSession
    doc = lines.select("feed", "file_seq", "file_name", F.try_parse_json("payload").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    one = doc.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("feed", "file_seq", "file_name", F.col("key").alias("name"), "value", F.schema_of_variant("value").alias("t"))
    t = F.col("t")
    # integers beyond 64 bits come as decimals of 19 digits and more without fraction
    whole = F.regexp_extract(t, r"^DECIMAL\((\d+),0\)$", 1).try_cast("int") >= 19
    kind = (
        F.when(t == "STRING", "string")
        .when((t == "BIGINT") | whole, "integer")
        .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "number")
        .when(t == "BOOLEAN", "boolean")
        .when(t.startswith("ARRAY"), "array")
        .when(t.startswith("OBJECT"), "object")
    )
    c, x = F.col("content"), F.col("content").try_cast("double")
    # only text that begins like a number or a date needs to be matched against their forms
    digits = (F.col("type") == "integer") | (F.col("type") == "number")
    like = digits | (c >= "-") & (c < ":")
    number = F.when(digits, F.length(c) <= 24).otherwise(c.rlike(r"^-?\d{1,18}(?:\.\d+)?(?:[eE][+-]?\d+)?$"))
    kinds = (
        F.when(F.col("type") == "boolean", "bool")
        .when(t.startswith("ARRAY<OBJECT") | (t == "ARRAY<VOID>"), "struct")
        .when(like & number, F.when(x.between(9e8, 4.2e9) | x.between(9e11, 4.2e12), "time").otherwise("num"))
        .when(like & c.rlike(r"^\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d|$)"), "time")
        .when(c.rlike(r"\s"), "text")
        .when(c.isNotNull(), "word")
    )
    return one.withColumns({"type": kind, "content": leaves(F.col("value"), t)}).withColumn("class", kinds).drop("value", "t")


def leaves(value: Column, t: Column) -> Column:
    """The content of a JSON value as text: scalars as they are, the values of arrays and objects joined by blanks."""
    return strip(
        F.when(t.startswith("ARRAY"), F.array_join(F.try_variant_get(value, "$", "array<string>"), " "))
        .when(t.startswith("OBJECT"), F.array_join(F.map_values(F.try_variant_get(value, "$", "map<string,string>")), " "))
        .when(t != "VOID", F.try_variant_get(value, "$", "string"))
    )


def headers(lines: DataFrame) -> DataFrame:
    """Per file and name the set of types and the profile of the content.

    Every part of it has a fixed width, so that the aggregation stays in compiled code; a value is hashed once, and its
    min-hashes are made from that hash.
    """
    x = F.when(F.col("class") == "num", F.col("content").try_cast("double"))
    kept = F.struct(F.col("type"), F.col("class"), F.length("content").alias("long"), F.xxhash64("content").alias("h"), x.alias("x"), *[(F.length("content") - F.length(F.translate("content", chars, ""))).alias(name) for name, chars in (("digits", "0123456789"), ("joints", "_-"))])
    # a generator is a barrier to the merging of projections: what it yields is computed once a row, not at every use
    one = values(lines).select("feed", "file_seq", "file_name", "name", F.inline(F.array(kept)))
    there, size, log = F.col("long").isNotNull(), F.greatest("long", F.lit(1)), F.log1p(F.abs("x"))
    bits = F.coalesce(*[F.when(F.col("type") == t, 1 << i) for i, t in enumerate(TYPES)])
    profile = F.struct(
        F.count("long").alias("n"), F.count(F.lit(1)).alias("met"), F.avg("long").alias("length"), F.avg(F.col("digits") / size).alias("digits"), F.avg(F.col("joints") / size).alias("joints"),
        F.array(*[F.count_if(F.col("class") == k) for k in CLASSES]).alias("classes"), F.avg(log).alias("log"), F.avg(log * log).alias("log2"), F.avg((F.col("x") < 0).cast("double")).alias("below"),
        F.array(*[F.min(F.when(there, F.hash(F.lit(i), "h"))) for i in range(HASHES)]).alias("mins"),
    )
    found = one.groupBy("feed", "file_seq", "file_name", "name").agg(F.coalesce(F.bit_or(bits), F.lit(0)).alias("bits"), profile.alias("profile"))
    types = F.filter(F.array(*[F.when(F.col("bits").bitwiseAND(1 << i) != 0, t) for i, t in enumerate(TYPES)]), lambda t: t.isNotNull())
    return found.select("feed", "file_seq", "file_name", "name", types.alias("types"), "profile")


def distinct(mins: list[int]) -> float:
    """Distinct values behind a min-hash: the least of d uniform hashes lies at 1 / (d + 1) on average."""
    mean = sum(int(m) / 2**32 + 0.5 for m in mins) / len(mins)
    return 1 / max(mean, 1e-18) - 1


def differ(a: float, b: float, n: int, m: int, va: float, vb: float) -> float:
    """By how many standard errors the means of two samples differ; one more value of unit variance keeps small ones from being sure."""
    return abs(a - b) / math.sqrt((max(va, 0.0) * n + 1) / (n + 1) / n + (max(vb, 0.0) * m + 1) / (m + 1) / m)


def alike(a: dict[str, Any], b: dict[str, Any]) -> float:
    """How far two profiles describe the same content, 0 to 1."""
    if not a["n"] or not b["n"]:
        return 0.0
    top = [max(range(len(CLASSES)), key=lambda i: (p["classes"][i], -i)) for p in (a, b)]
    if top[0] != top[1]:
        return 0.0
    shared = sum(x == y for x, y in zip(a["mins"], b["mins"])) / HASHES
    kind = CLASSES[top[0]]
    if kind == "time":
        # the same moments are in no two files; how many records hold one goes on
        parts = [p["n"] / p["records"] for p in (a, b)]
        return 0.9 if differ(parts[0], parts[1], a["records"], b["records"], *(q * (1 - q) for q in parts)) < SIGMAS or abs(parts[0] - parts[1]) < 0.25 else 0.3
    if kind in ("bool", "struct"):
        return 0.6 + 0.3 * shared if kind == "struct" and shared >= 0.18 else 0.3
    if kind == "num":
        z = [differ(a[k], b[k], a["n"], b["n"], va, vb) for k, va, vb in (("log", a["log2"] - a["log"] ** 2, b["log2"] - b["log"] ** 2), ("below", a["below"] * (1 - a["below"]), b["below"] * (1 - b["below"])))]
        return 0.8 - 0.05 * min(max(z), SIGMAS) if max(z) < SIGMAS else 0.0
    various = [distinct(p["mins"]) / p["n"] for p in (a, b)]
    off = abs(math.log(max(a["length"], 1) / max(b["length"], 1)))
    if shared >= 0.18:
        return 0.65 + 0.35 * shared - 0.05 * min(off, 2)
    if kind == "text":
        return 0.75 - 0.1 * off if min(various) > 0.4 and min(a["length"], b["length"]) >= 20 else 0.0
    # words that are all different: only their shape can go on
    slack = 1 / math.sqrt(min(a["n"], b["n"]))
    if min(various) > 0.4 and off < 0.3 and abs(a["digits"] - b["digits"]) < 0.1 + 0.4 * slack and abs(a["joints"] - b["joints"]) < 0.04 + 0.1 * slack:
        return 0.6 - 0.3 * off
    return 0.0


def pair_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Renamed pairs of each file from the names that went and those that came (as many as a file has names, at most)."""
    for pdf in batches:
        out: list[tuple[Any, ...]] = []
        for feed, seq, file, went, came, *records in zip(*(pdf[c] for c in ("feed", "file_seq", "file_name", "went", "came", "records_before", "records_now"))):
            found = []
            for o in went:
                for n in came:
                    s = alike(*({**x["profile"], "records": r} for x, r in zip((o, n), records))) + 0.4 * (o["name"].lower().replace("_", "") == n["name"].lower().replace("_", ""))
                    if s >= LEAST:
                        found.append((-s, o["name"], n["name"]))
            used: set[tuple[str, str]] = set()
            for _, o, n in sorted(found):
                if ("o", o) not in used and ("n", n) not in used:
                    used |= {("o", o), ("n", n)}
                    out.append((feed, seq, file, o, n))
        yield pd.DataFrame(out, columns=["feed", "file_seq", "file_name", "old", "new"])


def renames(beside: DataFrame) -> DataFrame:
    """``feed, file_seq, file_name, old, new`` of every renamed field."""
    went, came = F.col("now").isNull(), F.col("before").isNull()
    # a file has as many records as the name most of them hold
    both = beside.groupBy("feed", "file_seq", "file_name").agg(
        F.collect_list(F.when(went, F.struct("name", F.col("before.profile").alias("profile")))).alias("went"), F.collect_list(F.when(came, F.struct("name", F.col("now.profile").alias("profile")))).alias("came"),
        F.max("before.profile.met").alias("records_before"), F.max("now.profile.met").alias("records_now"),
    ).where("size(went) > 0 and size(came) > 0")
    return both.mapInPandas(pair_names, "feed string, file_seq int, file_name string, old string, new string")


def lay_beside(head: DataFrame) -> DataFrame:
    """``feed, file_seq, file_name, name, now, before``: each file's names beside those of the preceding file of the feed."""
    files = head.select("feed", "file_seq", "file_name").distinct()
    order = Window.partitionBy("feed").orderBy("file_seq", "file_name")
    after = files.select("feed", "file_seq", "file_name", F.lead(F.struct("file_seq", "file_name")).over(order).alias("next"), F.lag("file_seq").over(order).isNull().alias("is_first"))
    known = head.join(after, ["feed", "file_seq", "file_name"]).withColumn("h", F.struct("types", "profile"))
    none = F.lit(None)
    both = F.array(
        F.when(~F.col("is_first"), F.struct("file_seq", "file_name", F.col("h").alias("now"), none.cast(known.schema["h"].dataType).alias("before"))),
        F.when(F.col("next").isNotNull(), F.struct(F.col("next.file_seq").alias("file_seq"), F.col("next.file_name").alias("file_name"), none.cast(known.schema["h"].dataType).alias("now"), F.col("h").alias("before"))),
    )
    long = known.select("feed", "name", F.explode(both).alias("x")).where("x is not null").select("feed", "name", "x.*")
    return long.groupBy("feed", "file_seq", "file_name", "name").agg(F.first("now", True).alias("now"), F.first("before", True).alias("before"))


def changes(lines: DataFrame) -> DataFrame:
    """Every change of a file against the preceding one: ``feed, file_seq, file_name, change, old_field, new_field``.

    Headers are kept once found (a few hundred bytes per file and name), so that records are read and parsed once.
    """
    beside = materialise(lay_beside(materialise(headers(lines))))
    pairs = renames(beside)
    where = ["feed", "file_seq", "file_name"]
    # each renamed pair laid over its two names, so that both sides are known by one aggregation
    over = pairs.select(*where, F.explode(F.array("old", "new")).alias("name"), F.struct("old", "new").alias("pair"))
    named = beside.join(over, [*where, "name"], "left")
    alone = named.where("pair is null").select(*where, F.col("name").alias("old"), F.col("name").alias("new"), "now", "before", F.lit(False).alias("renamed"))
    met = named.where("pair is not null").groupBy(*where, "pair").agg(F.first("now", True).alias("now"), F.first("before", True).alias("before")).select(*where, "pair.old", "pair.new", "now", "before", F.lit(True).alias("renamed"))
    both = F.col("now").isNotNull() & F.col("before").isNotNull()
    retyped = both & (F.col("now.types") != F.col("before.types")) & (F.size("now.types") > 0) & (F.size("before.types") > 0)
    rows = F.array(
        F.when(F.col("before").isNull(), F.struct(F.lit("added").alias("change"), F.lit("").alias("old_field"), F.col("new").alias("new_field"))),
        F.when(F.col("now").isNull(), F.struct(F.lit("removed").alias("change"), F.col("old").alias("old_field"), F.lit("").alias("new_field"))),
        F.when(F.col("renamed"), F.struct(F.lit("renamed").alias("change"), F.col("old").alias("old_field"), F.col("new").alias("new_field"))),
        F.when(retyped, F.struct(F.lit("retyped").alias("change"), F.col("old").alias("old_field"), F.col("new").alias("new_field"))),
    )
    return alone.unionByName(met).select(*where, F.explode(rows).alias("r")).where("r is not null").select(*where, "r.*")


def _lineage(pdf: pd.DataFrame) -> pd.DataFrame:
    """Walk one feed's change log (one line per file and name, no records) in order: the first name a field went by."""
    root: dict[str, str] = {}
    out = []
    for (seq, file), g in pdf.sort_values(["file_seq", "file_name"]).groupby(["file_seq", "file_name"], sort=False):
        moved = {n: root.get(o, o) for n, o in zip(g["name"], g["old"]) if isinstance(o, str)}
        for n in g["name"]:
            root[n] = moved.get(n, root.get(n, n) if n not in moved else n)
        out += [(g["feed"].iloc[0], seq, file, root[n], n) for n in g["name"]]
    return pd.DataFrame(out, columns=["feed", "file_seq", "file_name", "field", "name"])


def lineage(lines: DataFrame, head: DataFrame | None = None) -> DataFrame:
    """``feed, file_seq, file_name, field, name``: what a field that first went by ``field`` is called in a file."""
    head = materialise(headers(lines)) if head is None else head
    where = ["feed", "file_seq", "file_name"]
    log = head.select(*where, "name").join(renames(lay_beside(head)).withColumnRenamed("new", "name"), [*where, "name"], "left")
    return log.groupBy("feed").applyInPandas(_lineage, "feed string, file_seq int, file_name string, field string, name string")


def union_schema(lines: DataFrame, head: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """Per field the types met, the union type they are promoted to, and in how many files the field occurs."""
    where = ["feed", "file_seq", "file_name"]
    head = materialise(headers(lines)) if head is None else head
    per = head.select(*where, "name", "types").join(lineage(lines, head) if names is None else names, [*where, "name"])
    folded = per.groupBy("field").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("types"), F.count(F.lit(1)).alias("n_files"))
    union = F.aggregate(
        "types", F.lit(None).cast("string"),
        lambda a, t: F.when(a.isNull() | (a == t), t).when(F.array_sort(F.array(a, t)).isin(*[F.array(*[F.lit(x) for x in sorted(p)]) for p in PROMOTION]), F.try_element_at(F.create_map(*[y for p, to in PROMOTION.items() for y in (F.lit(",".join(sorted(p))), F.lit(to))]), F.array_join(F.array_sort(F.array(a, t)), ","))).otherwise("json"),
    )
    return folded.select("field", F.array_join("types", ",").alias("types"), union.alias("union_type"), "n_files")


def columns_of(fields: list[str], taken: tuple[str, ...]) -> dict[str, str]:
    """Field -> column: its name, numbered where it differs only in case from an earlier column."""
    used, out = set(taken), {}
    for f in fields:
        n, name = 1, f
        while name.lower() in used:
            n += 1
            name = f"{f}_{n}"
        used.add(name.lower())
        out[f] = name
    return out


def records(lines: DataFrame) -> DataFrame:
    """All records in one consistent table: every field of the union schema under its first name, cast to its union type.

    ``integer`` is a bigint, ``number`` a double, ``boolean`` a boolean, ``string`` text; ``created_utc`` is in epoch
    seconds. Arrays and objects are JSON text; where a field holds scalars in other files, text of their values.
    ``uncast`` holds, as one JSON object by field, each value its column does not hold in full. The driver sees one row
    per field.
    """
    where = ["feed", "file_seq", "file_name"]
    head = materialise(headers(lines))
    log = materialise(lineage(lines, head))
    # fields of most files first: they keep their names
    met = sorted(union_schema(lines, head, log).collect(), key=lambda r: (-r["n_files"], r["field"]))
    union = {r["field"]: (r["union_type"], set(r["types"].split(","))) for r in met}
    called = columns_of(list(union), ("line_id", "feed", "file_name", "uncast"))
    names = log.groupBy(*where).agg(F.map_from_entries(F.collect_list(F.struct("field", "name"))).alias("names"))
    # the outer join keeps lines without a record
    doc = lines.select("line_id", *where, F.try_parse_json("payload").alias("v")).join(names, where, "left")
    parts = doc.select("line_id", "feed", "file_name", "names", F.try_variant_get("v", "$", "map<string,variant>").alias("parts"))
    fields = list(union)
    found = parts.select("line_id", "feed", "file_name", *[F.try_element_at("parts", F.try_element_at("names", F.lit(f))).alias(f"v{i}") for i, f in enumerate(fields)])
    cells, left = [], []
    for i, f in enumerate(fields):
        (to, types), v = union[f], F.col(f"v{i}")
        t = F.schema_of_variant(v)
        nested = t.startswith("ARRAY") | t.startswith("OBJECT")
        text = F.when(t != "VOID", F.try_variant_get(v, "$", "string"))
        if f == "created_utc":
            plain = leaves(v, t)
            iso = F.try_to_timestamp(F.regexp_replace(plain, "Z$", "+00:00"))
            cell = F.coalesce(F.floor(plain_number(plain) / 1_000_000), F.unix_seconds(iso))
            whole = cell.isNotNull() & ~nested
        elif to == "integer":
            cell = F.when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("bigint")).otherwise(F.try_variant_get(v, "$", "bigint"))
            whole = cell.isNotNull()
        elif to == "number":
            cell = F.when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).otherwise(F.try_variant_get(v, "$", "double"))
            # a double holds 15 digits
            whole = cell.isNotNull() & (F.length(F.regexp_replace(text, r"[eE].*$|[^0-9]", "")) <= 15)
        elif to == "boolean":
            cell = F.try_variant_get(v, "$", "boolean")
            whole = cell.isNotNull()
        elif to == "json" and types - {"array", "object"}:
            cell, whole = F.when(nested, leaves(v, t)).otherwise(text), ~nested
        else:
            cell, whole = text, F.lit(True)
        cells.append(cell.alias(called[f]))
        left.append(F.when((t != "VOID") & ~F.coalesce(whole, F.lit(False)), F.struct(F.lit(f).alias("key"), v.alias("value"))))
    if not fields:
        return found.withColumn("uncast", F.lit(None).cast("string"))
    uncast = F.filter(F.array(*left), lambda x: x.isNotNull())
    return found.select("line_id", "feed", "file_name", *cells, F.when(F.size(uncast) > 0, F.to_json(F.map_from_entries(uncast))).alias("uncast"))
