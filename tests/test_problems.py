"""The general data problems: small cases with nulls, ties, repeats, empty tables and clashing column names."""

import json
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewake.operators import badrows, distinct, drift, orphans, pointintime, redelivery, timestamps


def at(h, d=1):
    return datetime(2024, 1, d, h, tzinfo=UTC)


# --- drift


def archive(spark, files, feed="f"):
    """files: list of lists of records."""
    n, out = 0, []
    for seq, records in enumerate(files, 1):
        for k, r in enumerate(records):
            out.append((n, feed, f"{feed}/{seq}", seq, k, r if isinstance(r, (str, type(None))) else json.dumps(r)))
            n += 1
    return spark.createDataFrame(out, "line_id long, feed string, file_name string, file_seq int, line_no int, payload string")


def people(i):
    return f"amber_otter_{i % 5}{i * 37 % 1000}"


def test_drift_finds_every_kind_of_change(spark, rows):
    a = [{"id": f"k{i:05x}", "created_utc": 1_700_000_000 + i, "author": people(i), "body": f"a rather long sentence number {i} about prices"} for i in range(8)]
    b = [{"id": f"k{i:05x}q", "ts": f"2023-11-15T00:00:{i:02d}Z", "author": people(i), "body": [f"another long sentence {i}", "and one more"], "depth": i % 3} for i in range(8)]
    c = [{"id": f"k{i:05x}z", "ts": f"2023-12-15T00:00:{i:02d}Z", "username": people(i), "body": [f"more long text {i}"], "edited": True} for i in range(8)]
    got = rows(drift.changes(archive(spark, [a, b, c])).select("file_name", "change", "old_field", "new_field"))
    assert got == sorted([
        ("f/2", "renamed", "created_utc", "ts"), ("f/2", "retyped", "created_utc", "ts"), ("f/2", "retyped", "body", "body"), ("f/2", "added", "", "depth"),
        ("f/3", "renamed", "author", "username"), ("f/3", "removed", "depth", ""), ("f/3", "added", "", "edited"),
    ], key=repr)


def test_drift_integers_and_fractions_differ_but_nulls_and_gaps_do_not(spark, rows):
    files = [[{"id": "a", "score": 1, "x": "t"}, {"id": "b", "x": None}], [{"id": "c", "score": 1.0, "x": None}, {"id": "d"}], [{"id": "e", "score": 2.5, "x": "u"}]]
    assert rows(drift.changes(archive(spark, files)).select("file_name", "change", "old_field")) == [("f/2", "retyped", "score")]


def test_drift_bad_payloads_and_empty_tables(spark):
    files = [[{"id": "a"}], ["not json", None, "[1]", "3"], [{"id": "b"}]]
    assert drift.changes(archive(spark, files)).count() == 0
    assert drift.changes(archive(spark, [])).count() == 0


def test_drift_records_follow_renames_and_promote_types(spark):
    a = [{"id": f"k{i:05x}", "created_utc": 1_700_000_000 + i, "author": people(i), "body": f"a rather long sentence number {i}"} for i in range(6)]
    b = [{"id": f"k{i:05x}q", "ts": f"2023-11-14T22:13:{20 + i}Z", "author": {"name": people(i)}, "body": f"a rather long sentence again {i}"} for i in range(6)]
    lines = archive(spark, [a, b])
    out = {r.id: r for r in drift.records(lines).collect()}
    assert out["k00002"].created_utc == 1_700_000_002 and out["k00002q"].created_utc == 1_700_000_002
    assert out["k00003q"].author == people(3)
    schema = {r.field: r.union_type for r in drift.union_schema(lines).collect()}
    assert schema["created_utc"] == "string" and schema["author"] == "json" and schema["id"] == "string"
    assert drift.promote(["integer", "number"]) == "number" and drift.promote(["array", "string"]) == "json" and drift.promote([]) is None


def test_drift_records_hold_every_field_in_its_union_type(spark):
    a = [{"id": f"k{i:05x}", "author": people(i), "depth": i, "edited": i % 2 == 0, "ratio": 1, "awards": [i, {"n": i}], "flag": i} for i in range(6)]
    b = [{"id": f"k{i:05x}q", "author": people(i), "depth": i, "edited": 17 + i, "ratio": 2.5, "awards": None, "flag": {"on": "x", "by": "y"}, "Depth": "other case", "it's $.odd": "q"} for i in range(5)] + [{"id": "big", "author": people(7), "depth": 10**20, "ratio": 9007199254740993}]
    lines = archive(spark, [a, b, ["not json", None]])
    table = drift.records(lines)
    out = {r.id: r.asDict() for r in table.collect()}
    types = dict(table.dtypes)
    assert {k: types[k] for k in ("id", "author", "depth", "edited", "ratio", "awards", "flag")} == {"id": "string", "author": "string", "depth": "bigint", "edited": "bigint", "ratio": "double", "awards": "string", "flag": "string"}
    assert table.count() == lines.count()
    assert [out["k00002"][k] for k in ("depth", "edited", "ratio", "flag", "uncast")] == [2, 1, 1.0, "2", None] and json.loads(out["k00002"]["awards"]) == [2, {"n": 2}]
    q = out["k00003q"]
    assert [q[k] for k in ("edited", "ratio", "awards", "flag", "it's $.odd")] == [20, 2.5, None, "y x", "q"] and json.loads(q["uncast"]) == {"flag": {"on": "x", "by": "y"}}
    assert (q["depth"], q["Depth_2"]) == (3, "other case")
    assert out["big"]["depth"] is None and json.loads(out["big"]["uncast"]) == {"depth": 10**20, "ratio": 9007199254740993}
    assert drift.records(archive(spark, [])).count() == 0


def test_fields_of_one_class_are_not_the_same_content(spark, rows):
    import random

    r = random.Random(4)
    a = [{"id": f"k{i:05x}", "stickied": i % 2 == 0, "ups": int(r.lognormvariate(3, 1.2)), "tags": [{"a": i}], **({"edited_at": 1_700_000_000 + i} if i % 5 == 0 else {})} for i in range(20)]
    b = [{"id": f"k{i:05x}q", "is_submitter": i % 2 == 1, "depth": i % 4, "awards": [{"b": i + 100}], "created_utc": 1_700_100_000 + i} for i in range(20)]
    got = rows(drift.changes(archive(spark, [a, b])).select("change", "old_field", "new_field"))
    assert got == sorted([*[("removed", x, "") for x in ("stickied", "ups", "tags", "edited_at")], *[("added", "", x) for x in ("is_submitter", "depth", "awards", "created_utc")]], key=repr)
    c = [{"id": f"k{i:05x}z", "points": int(r.lognormvariate(3, 1.2)), "Stickied": i % 2 == 0} for i in range(20)]
    got = rows(drift.changes(archive(spark, [a, c])).select("change", "old_field", "new_field"))
    assert ("renamed", "ups", "points") in got and ("renamed", "stickied", "Stickied") in got


# --- orphans


def tables(spark, comments, posts=(), threads=(), removals=()):
    c = spark.createDataFrame(comments, "row_id long, received_at timestamp, id string, created_utc long, link_id string, parent_id string, key string, n int")
    p = spark.createDataFrame(list(posts), "row_id long, received_at timestamp, id string")
    t = spark.createDataFrame([(x,) for x in threads], "id string")
    r = spark.createDataFrame([(x,) for x in removals], "fullname string")
    return c, p, t, r


def test_orphans_states_and_kinds(spark, rows):
    comments = [
        (1, at(1), "k1", 1, "t3_p1", "t3_p1", "x", 1),  # post comes later
        (2, at(5), "k2", 1, " T3_P1 ", "t1_k1", "x", 1),  # both there by now, spelled unevenly
        (3, at(5), "k3", 1, "p9", "k9", "x", 1),  # no prefix: post missing; any kind missing
        (4, at(5), "k4", 1, "th", "th", "x", 1),  # a thread is always there, under any kind too
        (5, at(5), "k5", 1, None, "  ", "x", 1),  # no references
        (6, at(5), "k6", 1, "t3_gone", "t1_gone", "x", 1),  # only the post was removed
        (7, at(5), "k7", 1, "t3_k1", "t3_k1", "x", 1),  # a comment's key is no post
        (8, at(5), "k8", 1, "th", "gone", "x", 1),  # any kind: a removal of any kind names it
        (9, at(4), "k9x", 1, "th", "t1_k10", "x", 1),
        (10, at(9), "k10", 1, "th", "t3_", "x", 1),
    ]
    got = rows(orphans.orphan_references(*tables(spark, comments, [(1, at(3), "P1"), (2, at(4), "p1")], ["th"], ["t3_gone", "t3_gone"])).select("row_id", "ref_field", "state"))
    assert got == sorted([
        (1, "link_id", "late"), (1, "parent_id", "late"), (3, "link_id", "missing"), (3, "parent_id", "missing"), (6, "link_id", "deleted"), (6, "parent_id", "missing"),
        (7, "link_id", "missing"), (7, "parent_id", "missing"), (8, "parent_id", "deleted"), (9, "parent_id", "late"),
    ], key=repr)


def test_orphans_ties_and_empty_tables(spark, rows):
    same = [(1, at(3), "a", 1, "t3_p", "t3_p", "x", 1)]
    assert orphans.orphan_references(*tables(spark, same, [(1, at(3), "p")])).count() == 0  # received together is received by then
    assert rows(orphans.orphan_references(*tables(spark, same)).select("state")) == [("missing",), ("missing",)]
    none = orphans.orphan_references(*tables(spark, []))
    assert none.count() == 0 and orphans.orphan_report(none).count() == 0


def test_orphan_report_counts_by_period(spark, rows):
    comments = [(i, at(1), f"k{i}", 1_704_067_200 + i, "t3_x", None, "x", 1) for i in range(3)] + [(9, at(1), "k9", None, "t3_x", None, "x", 1)]
    got = rows(orphans.orphan_report(orphans.orphan_references(*tables(spark, comments))))
    assert got == [("t3", "link_id", "missing", "2024-01", 3), ("t3", "link_id", "missing", None, 1)]


# --- instants

CASES = [
    ("ny", "1704067200", 1_704_067_200), ("ny", "1704067200000", 1_704_067_200), ("ny", "1704067200000000", 1_704_067_200), ("ny", "1.7040672E9", 1_704_067_200), ("ny", "1704067200.25", 1_704_067_200.25),
    ("ny", "2024-01-01T00:00:00Z", 1_704_067_200), ("ny", "2024-01-01t00:00:00z", 1_704_067_200), ("ny", "2024-01-01 00:00:00", 1_704_085_200), ("ny", "  2024-01-01 00:00 ", 1_704_085_200), ("ny", "2024-01-01", 1_704_085_200),
    ("ny", "20240101000000", 1_704_085_200), ("ny", "20240101T000000Z", 1_704_067_200), ("ny", "2024-01-01 05:00:00+05:00", 1_704_067_200), ("ny", "2024-01-01T05:00+05", 1_704_067_200), ("ny", "2024-01-01 05:30:00.000 +0530", 1_704_067_200),
    ("ny", "2024-01-01T00:00:00.123456Z", 1_704_067_200.123456), ("ny", "Mon, 01 Jan 2024 00:00:00 GMT", 1_704_067_200), ("ny", "1 Jan 2024 00:00:00", 1_704_085_200), ("ny", "January 1, 2024 12:00 AM", 1_704_085_200), ("ny", "January 1, 2024 12:00 PM", 1_704_128_400),
    ("ny", "Mon Jan 01 00:00:00 EST 2024", 1_704_085_200), ("ny", "Mon Jan 01 00:00:00 UTC 2024", 1_704_067_200), ("ny", "2024-01-01 00:00:00 America/New_York", 1_704_085_200), ("ny", "2024-01-01T09:00:00[Asia/Tokyo]", 1_704_067_200),
    ("ny", "01/02/2024 3:04:05 PM", 1_704_225_845), ("de", "01/02/2024 15:04", 1_706_796_240), ("de", "1.2.2024 15:04:05", 1_706_796_245),
    ("ny", "2023-11-05 01:30:00", 1_699_162_200),  # occurs twice: the first
    ("ny", "2023-03-12 02:30:00", 1_678_606_200),  # skipped: the offset before the change
    ("ny", "2023-03-12 02:30:00 EDT", 1_678_602_600),  # an abbreviation is its fixed offset
    ("no", "2024-01-01T00:00:00Z", 1_704_067_200), ("no", "2024-01-01 00:00:00", None), ("no", "01/02/2024 10:00", None), (None, "1704067200", 1_704_067_200),
    ("ny", None, None), ("ny", "", None), ("ny", "   ", None), ("ny", "soon (tm)", None), ("ny", "0", None), ("ny", "-1", None), ("ny", "946684800", None), ("ny", "2023-02-30 11:20:00", None), ("ny", "2023-13-05T10:00:00Z", None),
    ("ny", "31/11/2023 25:61", None), ("ny", "12:45:10", None), ("ny", "99999999999999999", None), ("ny", "1999-12-31 23:59:59", None), ("ny", "2100-01-01T00:00:00Z", 4_102_444_800), ("ny", "2100-01-01T00:00:01Z", None), ("ny", "2024-01-01 00:00:00 Mars/Base", None),
    ("ny", "2024-02-29", 1_709_182_800), ("ny", "2023-02-29", None), ("ny", "x" * 100_000, None), ("ny", "13/13/2024 1:00:00 PM", None), ("ny", "01/02/2024 13:04:05 PM", None),
]


def test_instants_of_every_form(spark):
    bulk = spark.createDataFrame([(i, f, x, "z") for i, (f, x, _) in enumerate(CASES)], "row_id long, feed string, created_utc string, zone string")
    feeds = spark.createDataFrame([("ny", "America/New_York", False), ("de", "Europe/Berlin", True)], "feed string, zone string, day_first boolean")
    got = {r.row_id: r.created_us for r in timestamps.with_instant(bulk, feeds).collect()}
    want = {i: None if t is None else round(t * 1_000_000) for i, (_, _, t) in enumerate(CASES)}
    assert {CASES[i]: got[i] for i in got if got[i] != want[i]} == {}
    assert timestamps.readable(bulk, feeds).count() == sum(t is not None for *_, t in CASES)
    assert timestamps.readable(bulk.limit(0), feeds).count() == 0
    assert timestamps.readable(bulk, feeds.limit(0)).count() > 0


# --- distinct counts


def test_distinct_counts_are_exact_and_partials_add_up(spark):
    day = 86_400
    m = [("a", 5, "$gme", "r"), ("a", 6, "GME ", "r"), ("b", 5, "GME", "s"), ("[deleted]", 5, "GME", "r"), (None, 5, "GME", "r"), ("c", None, "brk-b", "r"), ("c", 5 + day, "BRK.B", None), ("a", 7, None, "r")]
    mentions = spark.createDataFrame(m, "author string, created_utc long, symbol string, subreddit string")
    comments = spark.createDataFrame([("a", 1, "r"), ("a", 1, "r"), ("d", 1, "r")], "author string, created_utc long, subreddit string")
    asked = spark.createDataFrame([("gme",), ("NONE",), (None,)], "symbol string")
    got = {(r.source, r.level, r.day, r.symbol, r.subreddit): r.n_distinct for r in distinct.distinct_authors(mentions, comments, asked).collect()}
    d0, d1 = date(1970, 1, 1), date(1970, 1, 2)
    assert got["mentions", "symbol", None, "GME", None] == 2 and got["mentions", "symbol", None, "NONE", None] == 0 and got["mentions", "symbol", None, "BRK.B", None] == 1
    assert got["mentions", "day", d0, None, None] == 2 and got["mentions", "day", d1, None, None] == 1
    assert got["mentions", "day+symbol+subreddit", d0, "GME", "r"] == 1 and got["comments", "day+subreddit", d0, None, "r"] == 2
    assert not any(k[0] == "comments" and k[3] for k in got)
    pairs = distinct.sightings(mentions, "m")
    for ranges in (1, 7, 4096):
        p = distinct.partial_counts(pairs, ["day", "symbol"], ranges=ranges)
        assert {(r.level, r.day, r.symbol): r.n_distinct for r in distinct.merge_partials(p, ["day", "symbol"]).collect()}["symbol", None, "GME"] == 2
    assert distinct.distinct_authors(mentions.limit(0), comments.limit(0), asked.limit(0)).count() == 0


# --- bad rows


def csv(spark, files):
    out = []
    for name, lines in files.items():
        out += [(len(out) + k - 1, name, k, x) for k, x in enumerate(lines, 1)]
    return spark.createDataFrame(out, "line_id long, file_name string, line_no int, raw string")


def test_bad_rows_by_first_reason(spark):
    long = "w " * 60_000
    lines = {
        "a": [
            "id,created_utc,BODY", ("a,2024-01-01,hello", None), ('a,1704067200,"x, y"', None), ('a,1704067200000,"say ""hi"""', None), ('a,2024-01-01 10:00:00,"two\nlines"', None), (f"a,2024-01-01T10:00:00Z,{long}", None), ('"a","2024-01-01","' + '""' * 5000 + 'x"', None),
            ('a,2024-01-01,"open', "quoting"), ('a,2024-01-01,5" screens', "quoting"), ('a,2024-01-01,"x" y', "quoting"), ('a,2024-01-01,"x"y"', "quoting"), ('"a"b,2024-01-01', "quoting"),
            ("a,2024-01-01", "columns"), ("a,2024-01-01,x,y", "columns"), ("", "columns"), (",".join("x" * 5000), "columns"), (None, "columns"),
            ("a,soon,x", "created_utc"), ("a,,x", "created_utc"), ("a,2024-02-30,x", "created_utc"), ("a,2024-01-01 25:00:00,x", "created_utc"), ("a,2004-12-31,x", "created_utc"), ("a,170406720,", "created_utc"), ("a,2100-01-01T00:00:01,x", "created_utc"), ("a, 2100-01-01 ,x", None),
            ("a,2024-01-01,", "body"), ('a,2024-01-01,""', "body"), ("a,2024-01-01, \t ", "body"), ('a,2024-01-01,""""', None),
        ],
        "b": ["Created_UTC;body;id;score", ("2024-01-01;x,y;a;1", None), ('2024-01-01;"a;b";a;', None), ("2024-01-01,x,a,1", "columns")],
        "c": ["created_utc\tbody", ("2024-01-01\tx", None)], "d": ["id|created_utc|body"],
    }
    df = csv(spark, {f: [x if isinstance(x, str) else x[0] for x in v] for f, v in lines.items()})
    orphan = spark.createDataFrame([(999, "no header", 2, "a,2024-01-01,x")], df.schema)
    got = {r.line_id: r.reason for r in badrows.bad_rows(df.union(orphan)).collect()}
    n, want = 0, {999: "columns"}
    for v in lines.values():
        for x in v:
            if not isinstance(x, str) and x[1]:
                want[n] = x[1]
            n += 1
    assert got == want
    good = {r.line_id: r for r in badrows.valid_rows(df).collect()}
    assert good[2].body == "x, y" and good[3].body == 'say "hi"' and good[4].body == "two\nlines" and good[5].body == long and good[6].body == '"' * 5000 + "x"
    b = next(r for r in good.values() if r.file_name == "b" and r.score == "1")
    assert (b.body, b.id, b.author) == ("x,y", "a", None)
    assert badrows.bad_rows(df.limit(0)).count() == 0


# --- redelivery


def test_redelivery_keeps_the_first_copy(spark, rows):
    c = [
        (1, at(1), "a", "p"), (2, at(2), " T1_A ", "q"), (3, at(2, 20), "a", "r"), (4, at(1), "b", "s"), (5, at(1), "b", "s"), (6, at(1), None, "x"), (7, at(1), "", "x"), (8, at(1), "t1_", "x"),
        (9, at(5), "c", "late first by row"), (10, at(4), "c", "earlier"), (11, None, "d", "no time"), (12, at(9), "d", "d"), (13, at(9), "e", "once"),
    ]
    df = spark.createDataFrame([(*x, 1, 2) for x in c], "row_id long, received_at timestamp, id string, body string, at long, bucket long")
    assert rows(redelivery.repeats(df)) == [(11,), (2,), (3,), (5,), (9,)]
    assert {r.row_id for r in redelivery.unique_messages(df).collect()} == {1, 4, 6, 7, 8, 10, 12, 13}
    assert redelivery.repeats(df.limit(0)).count() == 0


def test_redelivery_across_many_buckets_matches_a_plain_count(spark):
    df = spark.range(20_000).select(F.col("id").alias("row_id"), (F.lit(at(0)) + F.make_interval(hours=(F.col("id") % 5000).cast("int"))).alias("received_at"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") * 7919 % 15_000).cast("string"))).alias("id"))
    keys = df.select("id").distinct().count()
    assert redelivery.repeats(df).count() == 20_000 - keys


def test_bloom_has_no_false_negatives():
    import numpy as np

    h = np.random.default_rng(1).integers(0, 1 << 63, 50_000).astype(np.uint64)
    bloom = redelivery.Bloom(20_000).add(h[:20_000])
    assert bloom.maybe(h[:20_000]).all() and bloom.maybe(h[20_000:]).mean() < 0.02


# --- point in time


def test_attributes_as_known(spark, rows):
    d = date(2024, 1, 1)
    ftd = date(2020, 1, 1)
    bars = [
        (1, "GME", d, 1.0, ftd, at(22)), (2, "gme ", d, 2.0, ftd, at(10, 3)), (3, "GME", d + timedelta(1), 3.0, ftd, at(22, 2)), (4, "GME", d + timedelta(2), 4.0, None, at(1, 3)),
        (5, "GME", d + timedelta(9), 5.0, ftd, at(1)), (6, "BRK.B", d, None, ftd, at(1)), (7, "NEW", d, 1.0, d + timedelta(30), at(1)), (8, "TIE", d, 1.0, ftd, at(1)), (9, "TIE", d, 1.0, ftd, at(1)), (10, None, d, 1.0, ftd, at(1)), (11, "OLD", date(2010, 1, 1), 1.0, date(2009, 1, 1), datetime(2010, 1, 1, 5, tzinfo=UTC)),
    ]
    prices = spark.createDataFrame([(*b, "x") for b in bars], "bar_id long, symbol string, day date, volume double, first_trade_date date, known_at timestamp, sym string")

    def ts(*a):
        return int(at(*a).timestamp())

    asked = [
        (1, "$gme", ts(21)), (2, "GME", ts(22)), (3, "GME", ts(23, 2)), (4, "GME", ts(11, 3)), (5, "GME", ts(1, 10)), (6, "gme", ts(0, 10)), (7, "brk-b", ts(1)), (8, "BRK/B", ts(0)),
        (9, "NEW", ts(1, 31)), (10, "TIE", ts(1)), (11, None, ts(1)), (12, "GME", None), (13, "OLD", ts(1)), (14, "GME", ts(22) - 1),
    ]
    mentions = spark.createDataFrame([(*m, 1) for m in asked], "mention_id long, symbol string, created_utc long, tb int")
    got = dict(rows(pointintime.as_known(mentions, prices)))
    assert got == {2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 6, 10: 9, 13: 11}
    assert pointintime.with_attributes(mentions, prices).count() == len(asked)
    assert pointintime.as_known(mentions, prices.limit(0)).count() == 0 and pointintime.as_known(mentions.limit(0), prices).count() == 0


@pytest.mark.parametrize("bucket", [3600, 86_400, 7 * 86_400])
def test_attributes_match_brute_force(spark, rows, bucket):
    import random

    r = random.Random(bucket)
    day0 = date(2024, 1, 1)
    bars = [(i, r.choice("AB"), day0 + timedelta(r.randrange(40)), 1.0, day0 + timedelta(r.randrange(-5, 20)), datetime(2024, 1, 1, tzinfo=UTC) + timedelta(hours=r.randrange(1200))) for i in range(120)]
    asked = [(i, r.choice("AB"), int(datetime(2024, 1, 1, tzinfo=UTC).timestamp()) + 3600 * r.randrange(1500)) for i in range(300)]
    prices = spark.createDataFrame(bars, "bar_id long, symbol string, day date, volume double, first_trade_date date, known_at timestamp")
    mentions = spark.createDataFrame(asked, "mention_id long, symbol string, created_utc long")
    want = {}
    for m, s, t in asked:
        now = datetime.fromtimestamp(t, UTC)
        ok = [(b[2], b[5], b[0]) for b in bars if b[1] == s and b[5] <= now and b[2] <= now.date() and b[4] <= b[2]]
        if ok:
            want[m] = max(ok)[2]
    assert dict(rows(pointintime.as_known(mentions, prices, bucket))) == want


def test_registered_partials_and_pairs_make_up_the_counts(spark, data, rows):
    from tidewake.plans import problems

    by = ["day", "symbol", "subreddit"]
    cols = ["source", "level", *by, "n_distinct"]
    want = rows(problems.p4_distinct(spark, data).where("n_distinct > 0").select(cols))
    assert rows(distinct.merge_partials(problems.p4_partials(spark, data), by).select(cols)) == want
    pairs = problems.p4_pairs(spark, data)
    # an author that two batches hold is counted once
    halves = [pairs.where("pmod(hash(author, level), 3) < 2"), pairs.where("pmod(hash(author, level), 3) > 0")]
    assert rows(distinct.merge_partials(distinct.count_groups(distinct.merge_groups(*halves), by), by).select(cols)) == want


# --- hot keys


@pytest.fixture
def tight(spark):
    """Settings under which small test tables are as skewed as large ones are by default; nothing is broadcast."""
    keep = {}
    for k, v in {"autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "-1", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000", "adaptive.skewJoin.skewedPartitionFactor": "1.2", "adaptive.advisoryPartitionSizeInBytes": "4000"}.items():
        keep[k] = spark.conf.get(f"spark.sql.{k}", None)
        spark.conf.set(f"spark.sql.{k}", v)
    yield
    for k, v in keep.items():
        spark.conf.unset(f"spark.sql.{k}") if v is None else spark.conf.set(f"spark.sql.{k}", v)


def run_plan(df):
    """The rows of a query, and its plan as it was run."""
    return len(df.collect()), df._jdf.queryExecution().executedPlan().toString()


def test_a_hot_missing_parent_splits_the_join(spark, tight):
    c = spark.range(40_000).select(F.col("id").alias("row_id"), F.concat(F.lit("c"), "id").alias("id"), F.col("id").alias("created_utc"), F.timestamp_seconds("id").alias("received_at"), F.when(F.col("id") % 2 == 0, "t3_hot").otherwise(F.concat(F.lit("t3_x"), "id")).alias("link_id"), F.lit(None).cast("string").alias("parent_id")).repartition(8)
    none = spark.createDataFrame([], "id string, received_at timestamp")
    n, plan = run_plan(orphans.orphan_references(c, none, none.select("id"), spark.createDataFrame([], "fullname string")))
    assert n == 40_000 and "skew=true" in plan


def test_a_hot_symbol_splits_the_join(spark, tight):
    m = spark.range(40_000).select(F.col("id").alias("mention_id"), F.when(F.col("id") % 2 == 0, "HOT").otherwise(F.concat(F.lit("S"), F.col("id") % 50)).alias("symbol"), (F.lit(1_704_067_200) + F.when(F.col("id") % 2 == 0, 10_000_000).otherwise(F.col("id"))).alias("created_utc")).repartition(8)
    names = ["HOT", *[f"S{k}" for k in range(1, 50, 2)]]
    prices = spark.createDataFrame([(i, s, date(2024, 1, 1), 1.0, date(2020, 1, 1), datetime(2023, 12, 31, tzinfo=UTC)) for i, s in enumerate(names)], "bar_id long, symbol string, day date, volume double, first_trade_date date, known_at timestamp")
    n, plan = run_plan(pointintime.as_known(m, prices))
    assert n == 40_000 and "skew=true" in plan


def test_a_hot_message_splits_the_join(spark, tight):
    c = spark.range(40_000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 15_000)).alias("id"), F.timestamp_seconds("id").alias("received_at")).repartition(8)
    n, plan = run_plan(redelivery.repeats(c))
    assert n == 40_000 - 1 - 7_500 and "skew=true" in plan


def test_seen_grows_without_losing_entries():
    import numpy as np

    r = np.random.default_rng(7)
    seen, parts = redelivery.Seen(room=64), [r.integers(0, 1 << 63, 500).astype(np.uint64) for _ in range(6)]
    for b, h in enumerate(parts):
        seen.close(b, h)
    assert len(seen.all) > 4
    for b, h in enumerate(parts):
        assert dict((bucket, at.size) for at, bucket in seen.matches(h))[b] == 500
    fresh = r.integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert len(np.unique(np.concatenate([at for at, _ in seen.matches(fresh)] or [np.zeros(0)]))) < 400
