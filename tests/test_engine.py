"""The engine's own operators on small tables."""

import json
import math
import random
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewake.functions import calendars, text
from tidewake.operators import bars, mentions, panel, retention, stack, threads
from tidewake.plans import crawl
from tidewake.schemas import COMMENT, COMMENT_TAGGED
from tidewake.sources import archive, bulk, pages
from tidewake.sources.manifest import Manifest, pending

D0 = date(2024, 1, 1)


def days(n):
    return [D0 + timedelta(i) for i in range(n)]


# --- panel


def scored(spark, counts, kind="long"):
    df = spark.createDataFrame([("X", d, c) for d, c in zip(days(len(counts)), counts)], f"symbol string, day date, authors {kind}")
    return df, {r.day: r.zscore for r in panel.rolling_zscores(df).collect()}


def test_zscore_looks_only_back(spark):
    _, z = scored(spark, [1] * 35 + [100] + [1] * 4)
    assert z[D0 + timedelta(34)] == 0 and z[D0 + timedelta(35)] == math.inf
    assert D0 + timedelta(9) not in z and D0 + timedelta(10) in z
    assert scored(spark, [1] * 5)[1] == {}
    counts = [random.Random(1).randrange(9) for _ in range(40)]
    assert {d: v for d, v in scored(spark, counts + [50])[1].items() if d < D0 + timedelta(40)} == scored(spark, counts)[1]


def test_zscore_of_fractions_without_spread(spark):
    assert set(scored(spark, [0.7] * 40, "double")[1].values()) == {0.0}
    assert scored(spark, [0.0] * 35 + [20.0], "double")[1][D0 + timedelta(35)] == math.inf


def test_events_need_people(spark):
    df, _ = scored(spark, [1] * 35 + [4])
    assert panel.attention_events(df).count() == 0
    df, _ = scored(spark, [1] * 35 + [20])
    assert [tuple(r)[:2] for r in panel.attention_events(df).collect()] == [("X", D0 + timedelta(35))]
    gaps = spark.createDataFrame([("X", D0, 1), ("X", D0 + timedelta(3), 2)], "symbol string, day date, authors long")
    assert [r.authors for r in panel.densify(gaps).orderBy("day").collect()] == [1, 0, 0, 2]


# --- bars


def series(spark, prices, volumes=None, first=date(2020, 1, 1), symbol="X"):
    v = volumes or [1e6] * len(prices)
    return spark.createDataFrame([(symbol, d, float(p), float(w), first) for d, p, w in zip(days(len(prices)), prices, v)], "symbol string, day date, adj_close double, volume double, first_trade_date date")


def test_returns(spark):
    b = series(spark, [100, 110, 120, 130])
    assert [r.forward and round(r.forward, 6) for r in bars.forward_return(b, 2).orderBy("day").collect()] == [0.2, round(130 / 110 - 1, 6), None, None]
    at = spark.createDataFrame([("X", D0), ("X", D0 + timedelta(2)), ("X", D0 + timedelta(99))], "symbol string, day date")
    got = {(r.day, r.offset): r.ret for r in stack.window_returns(at, series(spark, [100, 110, 121]), 2, 1).collect()}
    assert [got[D0, o] for o in (-2, -1, 0)] == [None] * 3 and round(got[D0, 1], 9) == 0.1
    assert round(got[D0 + timedelta(2), -1], 9) == 0.1 and got[D0 + timedelta(2), 1] is None and got[D0 + timedelta(99), 0] is None
    assert [r.ret for r in bars.indexed(series(spark, [0, 5])).orderBy("day").collect()] == [None, None]


def test_trailing_value_and_buckets(spark):
    b = bars.dollar_volume(series(spark, [10, 10, 10, 1000], [1e6, 1e6, 1e6, 1e9]), 2)
    assert {r.day: r.dollar_volume for r in b.collect()}[D0 + timedelta(1)] == 1e7
    assert bars.dollar_volume(series(spark, [10], [0])).head().size_bucket is None
    got = spark.createDataFrame([(5e9,), (5e8,), (1e8,), (1e7,), (1e5,), (None,)], "v double").select(bars.size_bucket(F.col("v")).alias("b")).collect()
    assert [r.b for r in got] == ["mega", "large", "mid", "small", "micro", None]


def test_listing_flags(spark):
    rows = [(D0, D0), (D0, D0 + timedelta(1)), (D0 + timedelta(365), D0), (D0 + timedelta(366), D0), (D0, None)]
    got = spark.createDataFrame(rows, "day date, f date").select(bars.was_listed(F.col("day"), F.col("f")).alias("a"), bars.newly_listed(F.col("day"), F.col("f")).alias("b")).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (True, True), (True, False), (False, False)]


def test_chart_payloads(spark):
    def chart(adj, first=1577836800):
        return json.dumps({"meta": {"firstTradeDate": first}, "timestamp": [1704153600, 1704240000, 1704326400], "indicators": {"quote": [{"close": [1.0, 2.0, 3.0], "volume": [5, None, 7]}], "adjclose": [{"adjclose": adj}]}})

    df = spark.createDataFrame([("A", chart([10.0, None, 30.0])), ("B", chart([])), ("C", chart(None, 0)), ("D", "{}"), ("E", None)], "symbol string, payload string")
    got = {s: [(r.adj_close, r.volume) for r in bars.chart_bars(df).orderBy("day").collect() if r.symbol == s] for s in "ABCDE"}
    assert got == {"A": [(10.0, 5.0), (30.0, 7.0)], "B": [(1.0, 5.0), (2.0, 0.0), (3.0, 7.0)], "C": [(1.0, 5.0), (2.0, 0.0), (3.0, 7.0)], "D": [], "E": []}
    assert {r.symbol: r.first_trade_date for r in bars.chart_bars(df).collect()} == {"A": date(2020, 1, 1), "B": date(2020, 1, 1), "C": None}


def test_price_report(spark):
    one = lambda *s: spark.createDataFrame([(x,) for x in s], "symbol string")
    r = bars.price_report(bars.price_status(one("A", "B", "C", "D"), one("A", "A"), one("D"))).head()
    assert tuple(r) == (1, 2, 1, 2 / 3)


# --- stack


def planted(spark, jump_at, n=200, seed=1):
    r = random.Random(seed)
    rows = [("X", D0 + timedelta(i), o, r.gauss(0, 0.01) + (0.05 if o == jump_at else 0)) for i in range(n) for o in range(-20, 21)]
    return spark.createDataFrame(rows, "symbol string, day date, offset int, ret double")


@pytest.mark.parametrize(("jump", "verdict"), [(3, "chatter leads price"), (-3, "chatter follows price")])
def test_planted_moves_are_read(spark, jump, verdict):
    assert stack.drift_verdict(stack.stack_events(planted(spark, jump))).head().verdict == verdict


def test_no_move_and_one_crowded_day(spark):
    d = stack.drift_verdict(stack.stack_events(planted(spark, None, 400))).head()
    assert abs(d.pre_drift) < 0.01 and abs(d.post_drift) < 0.01
    crowd = spark.createDataFrame([(f"S{i}", D0, o, 0.1) for i in range(100) for o in (0, 1)], "symbol string, day date, offset int, ret double")
    assert tuple(stack.stack_size(crowd).head()) == (100, 1)
    assert all(r.mean_return == 0 and math.isnan(r.stderr) for r in stack.stack_events(crowd).collect())
    assert stack.stack_events(crowd.limit(0)).count() == 41


def test_paths_skip_unpriced_and_unlisted(spark):
    b = series(spark, [100, 110, 121]).union(series(spark, [1, 1, 1], first=D0 + timedelta(2), symbol="LATE"))
    events = spark.createDataFrame([("X", D0 + timedelta(1)), ("X", D0 + timedelta(50)), ("NONE", D0), ("LATE", D0)], "symbol string, day date")
    market = spark.createDataFrame([(d, 50.0) for d in days(3)], "day date, adj_close double")
    p = stack.event_paths(events, b, market, 1, 1)
    assert tuple(stack.stack_size(p).head()) == (2, 2)
    assert {(r.day, r.offset): r.ret and round(r.ret, 9) for r in p.collect()}[D0 + timedelta(1), 0] == 0.1


# --- mentions

LISTINGS = [("GME", "gamestop"), ("TSLA", "tesla"), ("NVDA", "nvidia"), ("IT", ""), ("ALL", ""), ("ON", ""), ("OPEN", ""), ("DD", ""), ("A", ""), ("SPY", ""), ("BRK.B", ""), ("PLTR", "palantir"), ("F", "ford")]
TEXTS = {
    "buy it now": {}, "BUY IT NOW": {}, "loading up on $GME and $TSLA": {"GME": "cashtag", "TSLA": "cashtag"}, "NVDA earnings tomorrow": {"NVDA": "bare"}, "my ALL calls printed today": {"ALL": "context"}, "ALL of it": {},
    "did my DD before buying": {}, "$DD is a chemicals play": {"DD": "cashtag"}, "tesla is overvalued": {"TSLA": "name"}, "$BRK.B is a fortress": {"BRK.B": "cashtag"}, "GME GME GME $GME gamestop to the moon": {"GME": "cashtag"}, "$TSLA tesla calls": {"TSLA": "cashtag"},
    "still holding $BBBY bags": {"BBBY": "cashtag"}, "$SPY puts": {}, "(NVDA), PLTR!": {"NVDA": "bare", "PLTR": "bare"}, "": {}, "🚀🚀🚀": {}, "3m": {}, "$gme": {"GME": "cashtag"}, "$gmé and $GME_": {}, "$ABCDEF": {}, "one two three four five six seven ALL eight nine ten eleven twelve thirteen calls": {}, "NVDA\x1cPLTR": {"NVDA": "bare", "PLTR": "bare"},
}


@pytest.fixture
def universe(spark):
    rows = [(0, s, n, "Y" if s == "SPY" else "N", "N") for s, n in LISTINGS] + [(1, "GME", "other", "N", "N"), (1, "TEST", "t", "N", "Y"), (1, "File Creation Time", "", "", "")]
    return mentions.build_universe(spark.createDataFrame(rows, "priority int, symbol string, name string, etf string, test string"))


def test_mentions(spark, universe):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(999, None)], "doc_id long, text string")
    got = {}
    for r in mentions.extract_mentions(docs, universe).collect():
        got.setdefault(r.doc_id, {})[r.symbol] = r.method
    assert {t: got.get(i, {}) for i, t in enumerate(TEXTS)} == TEXTS and 999 not in got
    assert {tuple(r) for r in mentions.unknown_cashtags(docs, universe).collect()} == {("BBBY", 1)}
    assert mentions.extract_mentions(docs, universe, include_etfs=True).where("symbol = 'SPY'").count() == 1
    assert mentions.high_confidence(mentions.extract_mentions(docs, universe)).where("method = 'context'").count() == 0
    assert mentions.extract_mentions(docs.limit(0), universe).count() == 0


def test_universe_tiers(spark, universe):
    tier = {r.symbol: r.tier for r in universe.collect()}
    assert (tier["IT"], tier["ALL"], tier["NVDA"]) == ("cashtag_only", "context_required", "safe") and "TEST" not in tier
    zipf = spark.createDataFrame([("gme", 4.0), ("nvda", 5.5)], "word string, zipf double")
    listed = spark.createDataFrame([(0, "GME", "Apple Inc. Common Stock", "N", ""), (0, "NVDA", "", "N", None)], "priority int, symbol string, name string, etf string, test string")
    assert {r.symbol: r.tier for r in mentions.build_universe(listed, zipf).collect()} == {"GME": "context_required", "NVDA": "cashtag_only"}


def test_company_names(spark):
    names = {"Apple Inc. Common Stock": "apple", "Apple Inc. - Common Stock": "apple inc. -", "Foo Holdings, Inc.": "foo holdings", "Ford Motor Company": "ford motor", "": "", " Inc.": ""}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.clean_company_name(F.col("n")).alias("c")).collect()
    assert {r.n: r.c for r in got} == names


def test_corpus_stopwords(spark):
    docs = spark.createDataFrame([(1, "The the cat"), (2, "cat dog ab"), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in mentions.corpus_stopwords(docs, 2).collect()] == [("cat", 2), ("the", 2)]


# --- threads


def thread(i, kind="daily_discussion", t=1_709_000_000, score=1, stickied=False, distinguished=None):
    return (i, "t", t, kind, "s", "a", score, stickied, distinguished)


SCHEMA = "id string, title string, created_utc long, thread_type string, subreddit string, author string, score long, stickied boolean, distinguished string"


def test_thread_dedupe_and_merge(spark):
    df = spark.createDataFrame([thread("a", score=999), thread("b", score=10, stickied=True), thread("c", "moves_tomorrow", score=3), thread("d", "moves_tomorrow", score=300), thread("e", t=1_709_100_000), thread("f", "weekend_discussion", distinguished="moderator"), thread("g", "weekend_discussion", score=99, distinguished="")], SCHEMA)
    assert {r.id for r in threads.dedupe_threads(df).collect()} == {"b", "d", "e", "f"}
    assert {r.id: r.score for r in threads.merge_last(df, df.where("id = 'a'").withColumn("score", F.lit(0).cast("long"))).collect()}["a"] == 0


def test_thread_titles(spark):
    titles = {"What Are Your Moves Tomorrow, January 5": "moves_tomorrow", "Daily Discussion Thread for May 1": "daily_discussion", "Weekend Discussion Thread": "weekend_discussion", "WEEKLY TENDIES THREAD": "weekly_tendies", "GME yolo": None, None: None}
    got = spark.createDataFrame([(t,) for t in titles], "t string").select("t", threads.classify_thread(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in got} == titles


def test_coverage(spark):
    jan, feb, mar = (int(datetime(2024, m, 2, tzinfo=UTC).timestamp()) for m in (1, 2, 3))
    df = spark.createDataFrame([thread(f"j{i}", t=jan) for i in range(22)] + [thread(f"m{i}", t=mar) for i in range(2)] + [thread("w", "weekend_discussion", t=feb)], SCHEMA)
    assert tuple(threads.coverage_report(df).head()) == (2, 22, "2024-03", "2024-02", 25)
    assert threads.coverage_report(df.limit(0)).head().months == 0


def test_caps_and_calendars(spark):
    c = spark.createDataFrame([(i, "x" if i < 50 else "y", i) for i in range(60)], "row_id long, link_id string, created_utc long")
    assert threads.cap_per_thread(c, 12).groupBy("link_id").count().where("count > 12").count() == 0
    assert [r.link_id for r in threads.truncated(c, 20).collect()] == ["x"]
    w = [tuple(r) for r in calendars.month_windows(spark, date(2024, 1, 15), date(2024, 4, 10)).orderBy("window_start").collect()]
    assert w[0] == (date(2024, 1, 15), date(2024, 2, 1)) and w[-1] == (date(2024, 4, 1), date(2024, 4, 10)) and all(a[1] == b[0] for a, b in zip(w, w[1:]))
    assert calendars.day_range(spark, D0, D0).count() == 0 and calendars.day_range(spark, D0, date(2024, 2, 1)).count() == 31
    assert calendars.month_windows(spark, D0, D0).count() == 0


# --- records, archive, bulk files


def test_retention(spark):
    rows = [("[deleted]", "a"), ("[removed]", "a"), ("  [deleted]\t", "a"), ("", "a"), (None, "a"), ("live", "[deleted]")]
    df = spark.createDataFrame(rows, "body string, author string").withColumn("row_id", F.lit(1))
    assert retention.live(df).count() == 3
    assert tuple(retention.retention_report(df).head()) == (6, 3, 0.5)
    assert tuple(retention.retention_report(df.limit(0)).head()) == (0, 0, 0.0)
    heavy = df.withColumns({"media": F.lit(1), "_source": F.lit("x"), "all_awardings": F.lit(2)})
    assert retention.project(heavy).columns == ["body", "author", "_source"]


def test_compare_sources(spark):
    one = lambda rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, id string, body string")
    r = retention.compare_sources(one([("a", "x"), ("b", "x"), ("c", "x")]), one([("a", "x"), ("b", "[deleted]"), ("d", "x")])).head()
    assert (r.in_both, r.archive_only, r.api_only, r.text_lost_to_deletion, r.overlap_share) == (2, 1, 1, 1, 0.5)


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_archive_by_month_and_purge(spark, tmp_path, fmt):
    rec = [("a", 1_704_067_200, "GME 🚀🚀 café"), ("b", 1_704_069_000, "[deleted]"), ("c", 1_706_745_600, "kept"), ("d", 1_709_251_200, "[removed]")]
    df = spark.createDataFrame(rec, "id string, created_utc long, body string")
    root = str(tmp_path)
    assert archive.append(df.limit(2), root, "comments", fmt) == 2 and archive.append(df.where("id in ('c', 'd')"), root, "comments", fmt) == 2
    back = archive.read(spark, root, "comments", COMMENT, fmt=fmt)
    assert [r.month for r in archive.months(back).collect()] == ["2024-01", "2024-02", "2024-03"]
    assert archive.read(spark, root, "comments", COMMENT, "2024-01", fmt).count() == 2 and archive.read(spark, root, "nothing", COMMENT, fmt=fmt).count() == 0
    assert back.where("id = 'a'").head().body == "GME 🚀🚀 café"
    assert archive.purge(spark, root, "comments", COMMENT, fmt=fmt) == {"2024-01": 1, "2024-03": 1}
    assert {r.id for r in archive.read(spark, root, "comments", COMMENT, fmt=fmt).collect()} == {"a", "c"}
    assert archive.purge(spark, root, "comments", COMMENT, fmt=fmt) == {}
    live = spark.createDataFrame([("c",)], "id string")
    assert archive.purge(spark, root, "comments", COMMENT, live, fmt) == {"2024-01": 1}
    assert {r.id for r in archive.read(spark, root, "comments", COMMENT, fmt=fmt).collect()} == {"c"}


def test_manifest(spark, tmp_path):
    m = Manifest(spark, str(tmp_path))
    assert not m.is_done("u1") and m.summary().count() == 0
    m.mark_done("u1", "posts", 3)
    m.mark_done("u1", "posts", 10)
    m.mark_done("u2", "comments", 1)
    m.note_issue("u1", "truncated", "x")
    assert m.is_done("u1") and {tuple(r) for r in m.summary().collect()} == {("posts", 1, 10), ("comments", 1, 1)}
    assert m.issues().head().kind == "truncated" and m.issues(1).count() == 1 and [r.unit_key for r in m.done_keys("posts").collect()] == ["u1"]
    units = crawl.post_units(spark, ["a", "b"], D0, date(2024, 1, 3))
    assert units.count() == 4 and pending(units, units.limit(1)).count() == 3


def test_bulk_columns():
    assert bulk.resolve_columns(["Comment_ID", " timestamp ", "comment"]) == {"id": "Comment_ID", "created_utc": " timestamp ", "body": "comment"}
    assert bulk.resolve_columns(["post_id", "date", "selftext"]) == {"id": "post_id", "created_utc": "date", "body": "selftext", "link_id": "post_id"}
    with pytest.raises(bulk.SchemaError, match="created_utc"):
        bulk.resolve_columns(["foo", "bar", "body"])


def test_epoch_of_text(spark):
    good = ["1704067200", "1704067200000", "2024-01-01 00:00:00", "2024-01-01T00:00:00", "2024-01-01", "2024-01-01T00:00:00Z", " 1704067200.9 ", "2024-01-01 00:00:00+05:00"]
    bad = [None, "", "not a date", "0", "-1", "946684800", "99999999999999", "inf", "nan", "2024-13-01"]
    df = spark.createDataFrame([(x,) for x in good + bad], "x string").select("x", calendars.parse_timestamp(F.col("x")).alias("t"))
    assert {r.x: r.t for r in df.collect()} == {x: 1_704_067_200 for x in good} | dict.fromkeys(bad)


def test_ingest_csv(spark, tmp_path):
    src = tmp_path / "c.csv"
    src.write_bytes(b'id,created_utc,body,author,score\na,1704067200,"two\nlines",x,5\na,1704067200,again,x,1\nb,soon,x,x,1\nc,1704067200, ,x,1\nd,1704067200,[removed],x,1\n,1704067200,caf\xe9 ""quoted"",x,N/A\nd,1704067200,live copy,x,1\n')
    r = bulk.ingest_csv(spark, str(src), str(tmp_path / "raw"), "src").head()
    assert (r["read"], r.bad_timestamp, r.missing_body, r.duplicate, r.withdrawn, r.written) == (7, 1, 1, 2, 1, 2)
    got = {x.id: x for x in archive.read(spark, str(tmp_path / "raw"), "bulk/src", COMMENT_TAGGED).collect()}
    assert set(got) == {"a", "src:5"} and got["a"].body == "two\nlines" and got["a"].score == 5 and got["src:5"].score is None and "�" in got["src:5"].body


def test_rows_are_numbered_and_deduplicated_by_file(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text("id,created_utc,body\n" + ("y,1704067200,first\n" if name == "b" else "") + "x,1704067200,one\n,1704067200,two\nx,1704067200,three\n")
    done = bulk.classify(bulk.normalise(bulk.scan(spark, str(tmp_path)), "s"))
    got = {(r["_file"][-5:], r["_row"]): (r.id, r.reason) for r in done.collect()}
    assert got == {("a.csv", 0): ("x", "written"), ("a.csv", 1): ("s:1", "written"), ("a.csv", 2): ("x", "duplicate"), ("b.csv", 0): ("y", "written"), ("b.csv", 1): ("x", "written"), ("b.csv", 2): ("s:2", "written"), ("b.csv", 3): ("x", "duplicate")}
    assert {(r["_file"][-5:], r["read"], r.duplicate) for r in bulk.ingest_report(done, ("_file",)).collect()} == {("a.csv", 3, 1), ("b.csv", 4, 1)}


CORPUS = [{"id": f"k{i}", "created_utc": 100 + i // 3, "body": "x"} for i in range(700)] + [{"id": f"c{i}", "created_utc": 400, "body": "x"} for i in range(260)]


def answer(params):
    """One request to the corpus above, as a source answers it."""
    from tidewake.sources.pacing import Answer

    hit = sorted((r for r in CORPUS if params["after"] < r["created_utc"] < params["before"]), key=lambda r: (r["created_utc"], r["id"]), reverse=params["sort"] == "desc")
    return Answer(200, hit[: params["limit"]])


def test_search_follows_the_cursor(spark, monkeypatch):
    from tidewake.sources import pacing, search

    lost = []
    got = [r["id"] for r in search.walk(lambda p: answer(p).body, {}, 0, 1000, lost=lost.append)]
    assert len(got) == len(set(got)) == 900 and lost == [400]  # of the crowded second both ends, 200 of 260
    assert {f"k{i}" for i in range(700)} <= set(got)
    assert [r["id"] for r in search.walk(lambda p: answer(p).body, {}, 0, 1000, limit=5)] == ["k0", "k1", "k2", "k3", "k4"]
    assert list(search.walk(lambda p: [], {}, 0, 10)) == []
    monkeypatch.setattr(pacing, "REQUESTS", None)
    windows = search._Windows(spark.createDataFrame([], "id string, created_utc long").schema, {"fetch": "x:y", "after": "0", "before": "300", "windows": "4"}).partitions()
    assert [(w.after, w.before) for w in windows] == [(0, 76), (75, 151), (150, 226), (225, 300)]
    both = [r["id"] for w in windows for r in search.walk(lambda p: answer(p).body, {}, w.after, w.before)]
    assert sorted(both) == sorted(r["id"] for r in CORPUS if 0 < r["created_utc"] < 300)
    spark.dataSource.register(search.Search)
    few = spark.read.format("search").options(fetch="tests.test_engine:answer", after=100, before=103).load()
    assert few.select("id").count() == 6
    with pytest.raises(pacing.MissingCredentials, match="NO_SUCH_KEY"):
        search.credentials("NO_SUCH_KEY")


def test_cached_text_is_fetched_once(tmp_path):
    from tidewake.sources.search import cached

    seen = []
    for refresh in (False, False, True):
        assert cached(str(tmp_path / "a" / "x.json"), lambda: seen.append(1) or f"v{len(seen)}", refresh) == f"v{1 + refresh}"


def test_listings_and_frequencies(spark, tmp_path):
    from tidewake.sources import listings

    (tmp_path / "n.txt").write_text("Symbol|Security Name|Test Issue|ETF\nGME|Other Name|N|N\nSPY|Fund|N|Y\nZZT|t|Y|N\nFile Creation Time: 1|||\n")
    (tmp_path / "o.txt").write_text("ACT Symbol|Security Name|ETF|Test Issue\nIBM|Big Corp. Common Stock|N|N\n")
    (tmp_path / "s.json").write_text(json.dumps({"0": {"ticker": "gme", "title": "GAMESTOP CORP."}}))
    u = mentions.build_universe(listings.listings(listings.json_listing(spark, str(tmp_path / "s.json"), 0), listings.pipe_listing(spark, str(tmp_path / "n.txt"), 1), listings.pipe_listing(spark, str(tmp_path / "o.txt"), 2)))
    assert {(r.symbol, r.name, r.is_etf) for r in u.collect()} == {("GME", "gamestop", False), ("SPY", "fund", True), ("IBM", "big", False)}
    (tmp_path / "w.tsv").write_text("the\t7.7\n\"odd\t1.0\nbad\n")
    assert {tuple(r) for r in listings.word_frequencies(spark, str(tmp_path / "w.tsv")).collect()} == {("the", 7.7), ('"odd', 1.0)}
    assert {tuple(r) for r in listings.zipf_of(spark.createDataFrame([("a", 1), ("b", 9)], "word string, n long")).selectExpr("word", "round(zipf, 6)").collect()} == {("a", 8.0), ("b", 8.954243)}


def test_price_outcomes_are_cached_but_errors_are_not(spark):
    s = "symbol string, payload string, error string"
    asked = spark.createDataFrame([("A",), ("B",), ("C",), ("D",), ("E",)], "symbol string")
    cache = spark.createDataFrame([("A", "old", None), ("B", None, None)], s)
    fetched = spark.createDataFrame([("A", "new", None), ("C", None, "timeout"), ("D", None, None)], s)
    out = bars.fetch_outcomes(asked, cache, fetched)
    assert {tuple(r) for r in out.collect()} == {("A", "new", "ok"), ("B", None, "no_data"), ("C", None, "error"), ("D", None, "no_data"), ("E", None, "error")}
    assert {tuple(r) for r in bars.cacheable(out).collect()} == {("A", "new"), ("B", None), ("D", None)}
    assert {tuple(r) for r in bars.status_lists(out).collect()} == {("ok", "A"), ("no_data", "B,D"), ("error", "C,E")}


def test_ranked_collection_is_capped_before_withdrawn_ones_are_dropped(spark):
    raw = spark.createDataFrame([(3, "c", "u", "x"), (1, "a", None, "x"), (2, "b", "u", "[deleted]")], "rank int, id string, author string, body string")
    assert [(r.id, r.author) for r in pages.collect_ranked(raw, "t", "daily", "s", 2).collect()] == [("a", "[deleted]")]
    assert pages.collect_ranked(raw, "t", "daily", "s").count() == 2


def test_pages(spark, tmp_path):
    (tmp_path / "p1.jsonl").write_text("\n".join(json.dumps({"id": f"k{i}", "created_utc": i, "body": "x", "link_id": "t3_a" if i % 2 else "t3_b"}) for i in range(10)) + "\n\n")
    (tmp_path / "p2.jsonl").write_text("\n".join(json.dumps({"id": f"k{i}", "created_utc": i, "body": "x"}) for i in range(8, 15)))
    spark.dataSource.register(pages.RecordedPages)
    read = spark.read.format("recorded_pages").option("path", str(tmp_path))
    assert pages.paginate(read.load()).count() == 15 and [r.id for r in pages.paginate(read.load(), 2).collect()] == ["k0", "k1"]
    assert read.option("after", 3).option("before", 6).load().count() == 2 and spark.read.format("recorded_pages").option("path", str(tmp_path)).option("link_id", "t3_a").load().count() == 5
    crowd = spark.range(240).select(F.col("id").cast("string").alias("id"), F.lit(7).cast("long").alias("created_utc"))
    assert tuple(pages.crowded_seconds(crowd).head()) == (7, 240, 200, 40) and pages.recovered(crowd).count() == 200 and pages.recovered(crowd.limit(150)).count() == 150
    raw = spark.createDataFrame([("a", None, "x"), ("b", "u", "[deleted]")], "id string, author string, body string")
    assert [r.author for r in pages.api_records(raw, "t", "daily", "s").collect()] == ["[deleted]"]
    assert tuple(pages.collection_stats(raw).head()) == (1, 1, 1.0)


def test_crawl_plans(spark, tmp_path):
    found = spark.createDataFrame([("a", "Daily Discussion Thread x", 1), ("a", "Daily discussion thread x", 2), ("b", "my trade", 3)], "id string, title string, created_utc long")
    assert [(r.id, r.created_utc) for r in crawl.discover_threads(found).collect()] == [("a", 2)]
    book = Manifest(spark, str(tmp_path / "m"))
    posts = spark.createDataFrame([("a", 1_704_067_200, "t", "[removed]", "s", 1), ("b", 1_704_067_200, "t", "ok", "s", 1), ("c", 1_704_153_600, "t", "ok", "s", 1)], "id string, created_utc long, title string, selftext string, subreddit string, media int")
    units = crawl.post_units(spark, ["s", "quiet"], D0, D0 + timedelta(1))
    assert crawl.store_posts(posts, book, str(tmp_path), units) == 1 and crawl.store_posts(posts, book, str(tmp_path), units) == 0
    assert {(r.unit_key, r.record_count) for r in book.completed().collect()} == {("posts:s:2024-01-01", 1), ("posts:quiet:2024-01-01", 0)}
    which = spark.createDataFrame([("T1", "daily", "s"), ("t2", "daily", "s")], "id string, thread_type string, subreddit string")
    c = spark.createDataFrame([(f"k{i}", 1_704_067_200 + i, "x", "t3_t1" if i < 5 else "T3_T2") for i in range(7)], "id string, created_utc long, body string, link_id string")
    assert crawl.store_comments(c, which, book, str(tmp_path), 3) == 5 and crawl.store_comments(c, which, book, str(tmp_path), 3) == 0
    assert archive.read(spark, str(tmp_path), "comments", COMMENT_TAGGED).count() == 5 and [(r.unit_key, r.kind) for r in book.issues().collect()] == [("thread:T1", "truncated")]
    book.compact()
    assert book.completed().count() == 4 and book.is_done("thread:t2")


def test_command_line(spark, tmp_path, capsys):
    d = str(tmp_path / "d")
    assert crawl.main(["comments", "--data-dir", d, "--pages", d]) == 2
    pages_ = tmp_path / "t.json"
    pages_.write_text("\n".join(json.dumps({"id": i, "title": "Daily Discussion Thread", "created_utc": t, "subreddit": "s", "score": 1}) for i, t in (("a", 1_704_067_200), ("b", 1_704_153_600))))
    assert crawl.main(["discover", "--data-dir", d, "--pages", str(pages_)]) == 0
    pages_.write_text(json.dumps({"id": "a", "title": "Daily Discussion Thread", "created_utc": 1_704_067_200, "score": 9}) + "\n" + json.dumps({"id": "c", "title": "Daily Discussion Thread", "created_utc": 1_704_240_000}))
    assert crawl.main(["discover", "--data-dir", d, "--pages", str(pages_)]) == 0
    assert {r.id: r.score for r in spark.read.schema(SCHEMA).json(f"{d}/threads").collect()} == {"a": 9, "b": 1, "c": None}
    comments = tmp_path / "c.json"
    comments.write_text("\n".join(json.dumps({"id": f"k{i}", "created_utc": 1_704_067_200 + i, "body": "x" if i else "[removed]", "link_id": "t3_a"}) for i in range(5)))
    assert crawl.main(["comments", "--data-dir", d, "--pages", str(comments), "--max-comments", "3"]) == 0
    assert archive.read(spark, f"{d}/raw", "comments", COMMENT_TAGGED).count() == 2
    assert crawl.main(["comments", "--data-dir", d, "--pages", str(comments), "--max-comments", "3"]) == 0
    assert archive.read(spark, f"{d}/raw", "comments", COMMENT_TAGGED).count() == 2  # nothing is stored twice
    src = tmp_path / "bulk"
    src.mkdir()
    assert crawl.main(["load", "--data-dir", d, "--pages", str(src)]) == 1
    (src / "b.csv").write_text("id,created_utc,body\na,1704067200,x\n")
    (src / "c.csv").write_text("id,nothing\na,b\n")
    (src / "notes.txt").write_text("x")
    assert crawl.main(["load", "--data-dir", d, "--pages", str(src)]) == 0 and spark.read.json(f"{d}/reports").head().written == 1
    assert crawl.main(["posts", "--data-dir", d, "--subreddits", "a", "--start", "2024-01-01", "--end", "2024-01-03", "--limit-units", "1"]) == 0
    assert crawl.main(["threads", "--data-dir", d]) == 0


def test_streaming_attention(spark, tmp_path):
    from tidewake.streaming import attention

    rows = [("GME", f"a{i % 5}", 1_704_067_200 + i) for i in range(50)] + [("TSLA", "x", 1_704_067_200 + 86_400)]
    spark.createDataFrame(rows, "symbol string, author string, created_utc long").write.parquet(str(tmp_path / "in"))
    got = []
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    q = attention.to_sink(attention.daily_authors(attention.files(spark, str(tmp_path / "in"), schema)), lambda b, i: got.append({(r.symbol, r.day): r.authors for r in b.collect()}), str(tmp_path / "state"), "complete")
    q.awaitTermination()
    assert got[-1] == {("GME", D0): 5, ("TSLA", D0 + timedelta(1)): 1}
    spark.createDataFrame([("k1", 1_704_067_200), (" T1_K1", 1_704_067_201), ("k2", 1_704_067_202), (None, 1)], "id string, created_utc long").write.parquet(str(tmp_path / "m"))
    ids = []
    q = attention.to_sink(attention.once_each(attention.files(spark, str(tmp_path / "m"), spark.read.parquet(str(tmp_path / "m")).schema)), lambda b, i: ids.extend(r.id for r in b.collect()), str(tmp_path / "state2"))
    q.awaitTermination()
    assert len(ids) == 2


def test_stream_of_many_files_counts_each_author_once(spark, tmp_path, rows):
    from tidewake.streaming import attention

    mentions = [("$gme" if i % 3 else "GME", f"a{i % 7}" if i % 11 else None, 1_704_067_200 + 3600 * (i % 40)) for i in range(200)]
    spark.createDataFrame(mentions, "symbol string, author string, created_utc long").repartition(20).write.parquet(str(tmp_path / "in"))
    src = spark.read.parquet(str(tmp_path / "in"))
    for _ in range(2):  # nothing is new the second time
        attention.store_pairs(attention.files(spark, str(tmp_path / "in"), src.schema, per_trigger=3), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    want = sorted({(("GME", D0 + timedelta(k)), len({m[1] for m in mentions if m[1] and (m[2] - 1_704_067_200) // 86_400 == k}), sum((m[2] - 1_704_067_200) // 86_400 == k for m in mentions)) for k in (0, 1)}, key=repr)
    assert [((s, d), a, n) for s, d, a, n in rows(attention.stored_daily_authors(spark, str(tmp_path / "out")))] == want
    assert len(list((tmp_path / "out").glob("batch=*"))) >= 7


def test_pacing():
    from tidewake.sources.pacing import CRAWL, REQUESTS, Answer, Asker, Pace, SourceError, crawl, step, summary

    slept, done = [], []

    def work(u):
        if u % 6:
            raise RuntimeError
        return 2

    out = summary(crawl(range(1, 25), work, lambda o: done.append(o.unit) if o.error is None else None, sleep=slept.append), 90)
    assert out == {"attempted": 24, "succeeded": 4, "failed": 20, "records": 8, "parks": 0, "success_rate": 4 / 24, "elapsed_minutes": 1.5} and done == [6, 12, 18, 24] and max(slept) <= 60
    slept.clear()
    seen = crawl(range(100), lambda u: 1 / 0, sleep=slept.append)
    assert len(seen) == 48 and summary(seen)["parks"] == 4 and slept.count(903.0) == 3 and seen[0][0].error.startswith("ZeroDivisionError")
    p = Pace.of(CRAWL)
    for _ in range(50):
        p = step(CRAWL, p, True)
    assert p.interval == 1.5
    for _ in range(11):
        p = step(CRAWL, p, False)
    assert p.interval == 48.0 and step(CRAWL, p, False).interval == 3.0
    assert crawl([1], lambda u: 1, budget=0.0, sleep=slept.append) == [] and summary([])["success_rate"] == 0.0
    slept.clear()
    answers = iter([Answer(429), Answer(503), Answer(429, reset=500.0), Answer(200, "ok")])
    asker = Asker(lambda params: next(answers), sleep=slept.append, jitter=lambda: 0.5)
    assert asker.ask({}) == "ok" and slept == [1.6, 3.5, 3.2, 6.5, 6.4, 90.0, 12.8] and asker.pace.interval == 12.8
    for _ in range(20 * 20):
        asker.pace = step(REQUESTS, asker.pace, True)
    assert asker.pace.interval == 1.6
    with pytest.raises(SourceError, match="for good"):
        Asker(lambda params: Answer(400, "bad"), sleep=slept.append).ask({})
    with pytest.raises(SourceError, match="no answer"):
        Asker(lambda params: Answer(500), sleep=slept.append).ask({})


def test_every_comment_of_a_thread_however_its_key_is_spelled(spark, tmp_path):
    from tidewake.plans import catalog

    c = [(i, "t3_th", i, "words", "a") for i in range(60)] + [(100, " T3_TH ", None, "words", "a"), (101, "th", 5, "words", "a"), (102, "t1_th", 5, "words", "a"), (103, "t3_th", 5, "[removed]", "a"), (104, None, 5, "words", "a")]
    spark.createDataFrame(c, "row_id long, link_id string, created_utc long, body string, author string").write.parquet(f"{tmp_path}/comments.parquet")
    spark.createDataFrame([("th", "daily_discussion", "s")], "id string, thread_type string, subreddit string").write.parquet(f"{tmp_path}/threads.parquet")
    assert sorted(r.row_id for r in catalog.QUERIES["thread_comments"](spark, str(tmp_path)).collect()) == [*range(60), 100, 101]
