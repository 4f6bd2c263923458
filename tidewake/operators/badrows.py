"""Rows that fail to parse (problem 5): the valid rows of CSV files loaded, the others with the reason they fail.

1. Layout: each file's header says its delimiter and where each name stands.
2. Permissive reading under an explicit schema (as many text columns as the header has, plus the corrupt record):
   the CSV parser keeps the raw text of rows whose count differs.
3. Reclassification by quoting, count and cast checks. The parser forgives bad quoting, so a row with a double quote
   is checked exactly: split at double quotes, the pieces at even places lie outside quotes and must begin and end
   at a delimiter (or be the empty piece of a doubled quote). The same pieces give the exact fields of such a row.

Everything runs inside the JVM in one pass over the headers and one over the rows. Layouts are written once and joined
by file name: broadcast if their bytes are few, else a shuffled join that AQE splits, as one file may hold a third of
all rows.

Cases: a null record or a file without header fails by ``columns``; an empty file (header only) gives no rows; a
line_no 1 that occurs twice counts once (the smaller line_id); very long fields and line breaks inside fields are
fine; extra columns of the table are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.functions.instants import HIGHEST, LOWEST
from tidewake.functions.keys import blank, strip
from tidewake.session import materialise

DELIMITERS = (",", ";", "|", "\t")
#: Headers wider than this are read by the exact path only.
WIDEST = 64
#: The parser gives up on a record with more fields than this; such a one goes the exact way too.
MOST = 2048
#: Parts fields in the exact path: a noncharacter, which no text has.
_MARK = "\uffff"
FIELDS = ("id", "created_utc", "body", "author", "score", "subreddit")


def layouts(lines: DataFrame) -> DataFrame:
    """``file_name, delim, names`` of each file from its header; names in lower case, trimmed, without quotes."""
    head = lines.where("line_no = 1").groupBy("file_name").agg(F.min_by("raw", "line_id").alias("head"))
    counts = [F.struct((F.length("head") - F.length(F.replace("head", F.lit(d)))).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)]
    return head.select("file_name", "head", F.greatest(*counts).getField("d").alias("delim")).select(
        "file_name", "delim", F.transform(F.split("head", F.concat(F.lit("\\Q"), "delim", F.lit("\\E"))), lambda n: F.lower(F.btrim(strip(n), F.lit('"')))).alias("names")
    )


def pieces(raw: Column) -> Column:
    """The record cut at its double quotes: even places lie outside, odd places inside quotes."""
    return F.split(F.replace(raw, F.lit(_MARK), F.lit(" ")), F.lit('"'), -1)


def quoting_holds(p: Column, delim: Column) -> Column:
    """Whether a record, cut by ``pieces``, is quoted as it should be."""
    last = F.size(p) - 1

    def wrong(s: Column, i: Column) -> Column:
        ends, begins = F.endswith(s, delim), F.startswith(s, delim)
        return (i % 2 == 0) & (s != "") & ~(((i == 0) | begins) & ((i == last) | ends))

    return (last % 2 == 0) & ~F.exists(F.transform(p, wrong), lambda w: w)


def exact_fields(p: Column, delim: Column) -> Column:
    """The fields of a well-quoted record."""
    last = F.size(p) - 1
    out = F.transform(p, lambda s, i: F.when(i % 2 == 1, s).when((s == "") & (i > 0) & (i < last), '"').otherwise(F.replace(s, delim, F.lit(_MARK))))
    return F.split(F.array_join(out, ""), F.lit(_MARK), -1)


def usable_time(t: Column) -> Column:
    """Whether trimmed text is epoch seconds or milliseconds, or an existing date or date and time, in range."""
    c = strip(t)
    n = F.when(c.rlike(r"^\d{1,18}$"), c.try_cast("long"))
    number = n.between(LOWEST, HIGHEST) | n.between(LOWEST * 1000, HIGHEST * 1000)
    shape = c.rlike(r"^\d{4}-\d\d-\d\d(?:[ T]\d\d:\d\d:\d\dZ?)?$")
    day = F.try_to_date(F.substr(c, F.lit(1), F.lit(10)), "yyyy-MM-dd")
    h, m, s = (F.coalesce(F.nullif(F.substr(c, F.lit(k), F.lit(2)), F.lit("")).try_cast("int"), F.lit(0)) for k in (12, 15, 18))
    at = F.unix_date(day).cast("long") * 86_400 + h * 3600 + m * 60 + s
    date = (h <= 23) & (m <= 59) & (s <= 59) & at.between(LOWEST, HIGHEST)
    return F.coalesce(F.when(n.isNotNull(), number).when(shape, date), F.lit(False))


def _tidy(names: list[str]) -> Callable[[Column], Column]:
    return lambda g: F.struct(F.array(*[F.coalesce(g.getField(n), F.lit("")) for n in names]).alias("fields"), g.getField("corrupt").alias("corrupt"))


def read_permissively(lines: DataFrame) -> DataFrame:
    """Every row after the header: ``line_id, raw, names, delim, fields, well_quoted, corrupt``.

    ``corrupt`` is the raw text of a record the CSV parser could not bring under its file's schema.
    """
    # written once, a row per file: the table is read for it and for the rows, and the join knows its size in bytes
    lay = materialise(layouts(lines))
    # at most 4 * 64 schemas, however many files there are
    shapes = lay.select("delim", F.size("names").alias("width")).where(F.size("names") <= WIDEST).distinct().collect()
    rows = lines.where("line_no > 1").select("line_id", "file_name", "line_no", "raw").join(lay, "file_name", "left")
    width = F.size("names")
    parsed = F.lit(None).cast("struct<fields:array<string>,corrupt:string>")
    for x in shapes:
        names = [f"f{i}" for i in range(x.width)]
        schema = ", ".join(f"{n} string" for n in names) + ", corrupt string"
        got = F.from_csv("raw", F.lit(schema), {"sep": x.delim, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt", "maxCharsPerColumn": "-1", "maxColumns": str(MOST), "inputBufferSize": "16384"})
        # the reader takes one line; a record that is blank or has line breaks goes the exact way
        here = (F.col("delim") == x.delim) & (width == x.width) & ~F.col("raw").rlike("[\r\n]") & ~blank(F.col("raw")) & (F.length("raw") - F.length(F.replace("raw", F.lit(x.delim))) < MOST - 1)
        parsed = F.when(here, F.get(F.transform(F.array(got), _tidy(names)), F.lit(0))).otherwise(parsed)
    # a generator is a barrier to the merging of projections: what it yields is computed once a row, not at every use
    kept = ("line_id", "file_name", "line_no", "raw", "names", "delim")
    cut = rows.select(*kept, F.inline(F.array(F.struct(pieces(F.col("raw")).alias("p"), parsed.alias("parsed")))))
    fields = F.when(F.col("parsed").isNotNull() & F.col("parsed.corrupt").isNull(), F.col("parsed.fields")).otherwise(exact_fields(F.col("p"), F.col("delim")))
    return cut.select(*kept, F.inline(F.array(F.struct(quoting_holds(F.col("p"), F.col("delim")).alias("well_quoted"), fields.alias("fields"), F.col("parsed.corrupt").alias("corrupt")))))


def field(name: str) -> Column:
    """The field under a header name; null where the header lacks it or the record is short."""
    return F.get("fields", F.nullif(F.array_position("names", name), F.lit(0)).cast("int") - 1)


def classify(lines: DataFrame) -> DataFrame:
    """The rows of ``read_permissively`` with ``reason``: null for valid rows, else the first check they fail."""
    reason = (
        F.when(F.col("raw").isNull() | F.col("names").isNull(), "columns")
        .when(~F.col("well_quoted"), "quoting")
        .when(F.size("fields") != F.size("names"), "columns")
        .when(~usable_time(field("created_utc")), "created_utc")
        .when(blank(field("body")), "body")
    )
    return read_permissively(lines).withColumn("reason", reason)


def bad_rows(lines: DataFrame) -> DataFrame:
    """``line_id, reason`` of every row after the header that can't be taken as a comment."""
    return classify(lines).where("reason is not null").select("line_id", "reason")


def valid_rows(lines: DataFrame) -> DataFrame:
    """The valid rows as comments: the fields by name, whatever their order in the file."""
    return classify(lines).where("reason is null").select("line_id", "file_name", *[field(f).alias(f) for f in FIELDS])
