"""Text of many forms to one instant, with built-in expressions only.

All forms are compiled into one alternation with named groups. A single ``regexp_replace`` rewrites a text to its
components, which are split once, checked against the calendar and assembled by integer day arithmetic; only texts
in a named zone ask the zone rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.functions.keys import strip

#: Readable instants, 2005-01-01 to 2100-01-01 (UTC, seconds), both ends included.
LOWEST, HIGHEST = 1_104_537_600, 4_102_444_800
MICRO = 1_000_000

#: Fixed offsets of zone abbreviations, in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_ZONE = r"[+-]\d{1,2}(?::?\d{2})?|[A-Za-z]{1,5}|[A-Za-z]+(?:/[A-Za-z0-9_+\-]+){1,2}"
_MON = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
_DOW = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?"


def _clock(i: str) -> str:
    """Time of day, AM or PM, and zone (bare, after a blank or in brackets; an offset may carry the zone's name too)."""
    return rf"(?:(?:[ T]|,?\s+)(?<h{i}>\d{{1,2}}):(?<n{i}>\d{{2}})(?::(?<s{i}>\d{{2}})(?:[.,](?<f{i}>\d{{1,9}}))?)?(?:\s*(?<p{i}>[ap])\.?m\.?(?![a-z]))?)?(?:\s*(?<z{i}>{_ZONE}))?(?:\s*\[(?<b{i}>{_ZONE})\])?"


#: name -> pattern. Groups: y year, o month number or name, d day, u and v the two leading parts of a date whose order
#: the feed decides, h n s f time of day, p half of the day, z and b zone.
FORMS = {
    "iso": rf"(?<y1>\d{{4}})[-/.](?<o1>\d{{1,2}})[-/.](?<d1>\d{{1,2}}){_clock('1')}",
    "basic": rf"(?<y2>\d{{4}})(?<o2>\d{{2}})(?<d2>\d{{2}})T(?<h2>\d{{2}})(?<n2>\d{{2}})(?:(?<s2>\d{{2}})(?:[.,](?<f2>\d{{1,9}}))?)?\s*(?<z2>{_ZONE})?",
    "digits": r"(?<y3>\d{4})(?<o3>\d{2})(?<d3>\d{2})(?:(?<h3>\d{2})(?:(?<n3>\d{2})(?:(?<s3>\d{2})(?<f3>\d{3}|\d{6})?)?)?)?",
    "numeric": rf"(?<u4>\d{{1,2}})[-/.](?<v4>\d{{1,2}})[-/.](?<y4>\d{{4}}){_clock('4')}",
    "day_month": rf"{_DOW}(?<d5>\d{{1,2}})[ -](?<o5>{_MON})[ -](?<y5>\d{{4}}){_clock('5')}",
    "month_day": rf"{_DOW}(?<o6>{_MON}) (?<d6>\d{{1,2}})(?:st|nd|rd|th)?,? (?<y6>\d{{4}}){_clock('6')}",
    "c_time": rf"{_DOW}(?<o7>{_MON})\s+(?<d7>\d{{1,2}}) (?<h7>\d{{1,2}}):(?<n7>\d{{2}}):(?<s7>\d{{2}})(?: (?<z7>{_ZONE}))? (?<y7>\d{{4}})",
}
PATTERN = "(?i)^(?:" + "|".join(FORMS.values()) + ")$"
_SEP = "\u001f"
_PARTS = "yoduvhnsfpzb"


def _template() -> str:
    return _SEP.join("".join(f"${{{p}{i}}}" for i in range(1, len(FORMS) + 1) if f"?<{p}{i}>" in PATTERN) for p in _PARTS)


def known_zones() -> list[str]:
    """Names both Python and the JVM take for zones."""
    import zoneinfo

    from pyspark.sql import SparkSession

    names = zoneinfo.available_timezones()
    spark = SparkSession.getActiveSession()
    try:
        names &= set(spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    except Exception:  # a session without a JVM gateway
        pass
    return sorted(n for n in names if "/" in n)


def plain_number(text: Column) -> Column:
    """Microseconds of a plain number that counts seconds, milliseconds or microseconds, whichever is in range; else null."""
    n = F.when(text.rlike(r"^\+?\d{1,20}(?:\.\d{1,9})?(?:[eE]\+?\d{1,2})?$"), text.try_cast("decimal(38,9)"))
    return F.coalesce(*[F.when(n.between(LOWEST * unit, HIGHEST * unit), F.floor(n * F.lit(MICRO // unit)).cast("long")) for unit in (1, 1_000, MICRO)])


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator, a barrier to the merging of projections: they are computed once a row, not at every use."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_instant(df: DataFrame, text: Column, zone: Column, day_first: Column, name: str) -> DataFrame:
    """``df`` with column ``name``: microseconds since 1970-01-01 UTC of ``text``, null if it names no existing instant in range.

    Text without zone is wall time in ``zone``. A wall time that occurs twice is its first occurrence, one that is
    skipped is taken with the offset before the change. Missing parts of the time of day are zero.
    """
    kept = df.columns
    df = once(df, _t=strip(text), _zone=zone, _dmy=day_first)
    df = once(df, _n=plain_number(F.col("_t")))
    # a plain number that counts is no date, so the pattern isn't tried on it
    df = once(df, _w=F.when(F.col("_n").isNull(), F.split(F.regexp_replace("_t", PATTERN, _template()), _SEP)))

    def s(p: str) -> Column:
        return F.nullif(F.get("_w", F.lit(_PARTS.index(p))), F.lit(""))

    def i(p: str) -> Column:
        return s(p).try_cast("int")

    names = F.array(*[F.lit(m) for m in MONTHS])
    df = once(
        df, _y=i("y"), _m=F.coalesce(i("o"), F.nullif(F.array_position(names, F.lower(F.substr(s("o"), F.lit(1), F.lit(3)))).cast("int"), F.lit(0)), F.when(F.col("_dmy"), i("v")).when(~F.col("_dmy"), i("u"))),
        _d=F.coalesce(i("d"), F.when(F.col("_dmy"), i("u")).when(~F.col("_dmy"), i("v"))), _h=F.coalesce(i("h"), F.lit(0)), _mi=F.coalesce(i("n"), F.lit(0)), _s=F.coalesce(i("s"), F.lit(0)),
        _us=F.coalesce(F.substr(F.rpad(s("f"), 6, "0"), F.lit(1), F.lit(6)).cast("int"), F.lit(0)), _half=F.lower(s("p")), _z=F.coalesce(s("z"), s("b")),
    )
    y, m, d, h, half, z = (F.col(c) for c in ("_y", "_m", "_d", "_h", "_half", "_z"))
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    days_in = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    clock = F.when(half.isNull(), h.between(0, 23)).otherwise(h.between(1, 12)) & (F.col("_mi") <= 59) & (F.col("_s") <= 59)
    real = clock & m.between(1, 12) & (d >= 1) & (d <= days_in) & y.between(1, 9999)
    # days since 1970-01-01 by years that begin in March, in integers
    yy = (y - F.when(m <= 2, 1).otherwise(0)).cast("long")
    yoe = yy % 400
    days = F.floor(yy / 400) * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1 - 719468
    hour = F.when(half.isNull(), h).otherwise(h % 12 + F.when(half == "p", 12).otherwise(0))
    df = once(df, _local=F.when(real, (days.cast("long") * 86_400 + hour * 3600 + F.col("_mi") * 60 + F.col("_s")) * MICRO + F.col("_us")))
    digits = F.regexp_replace(z, ":", "")
    # +h, +hh, +hmm, +hhmm
    hours = F.when(F.length(digits) <= 3, F.substr(digits, F.lit(2))).otherwise(F.substr(digits, F.lit(2), F.length(digits) - 3)).try_cast("int")
    minutes = F.when(F.length(digits) <= 3, 0).otherwise(F.substr(digits, F.length(digits) - 1).try_cast("int"))
    offset = F.when((hours <= 18) & (minutes <= 59), F.when(z.startswith("-"), -1).otherwise(1) * (hours * 60 + minutes))
    table = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v))])
    fixed = F.when(z.rlike("^[+-]"), offset).when(~F.contains(z, F.lit("/")), F.try_element_at(table, F.upper(z)))
    df = once(df, _named=F.when(z.isNull(), F.col("_zone")).when(F.contains(z, F.lit("/")), z), _fixed=F.when(z.isNotNull(), fixed))
    known = F.col("_named").isin(known_zones()) | F.col("_named").isin("UTC", "GMT")
    wall = F.when(known, F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("_local"), F.col("_named"))))
    df = once(df, _at=F.when(F.col("_named").isNull(), F.col("_local") - F.col("_fixed").cast("long") * 60 * MICRO).otherwise(wall))
    spelled = F.when(F.col("_at").between(LOWEST * MICRO, HIGHEST * MICRO), F.col("_at"))
    return df.select(*kept, F.coalesce("_n", spelled).alias(name))
