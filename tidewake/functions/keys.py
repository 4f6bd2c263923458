"""Normal forms of record keys, symbols and white space, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character Python's ``str.strip`` removes (Unicode white space and the four separators U+001C..U+001F).
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(c: Column | str) -> Column:
    """Without surrounding white space in the Unicode sense; null stays null."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(WHITE))


def blank(c: Column) -> Column:
    """True for null, empty and all-white text."""
    return F.coalesce(strip(c) == "", F.lit(True))


def key_kind(c: Column) -> Column:
    """``t1`` (comment), ``t3`` (post or thread) or null where the key carries no such prefix."""
    k = F.lower(strip(c))
    return F.when(k.startswith("t1_"), "t1").when(k.startswith("t3_"), "t3")


def norm_key(c: Column) -> Column:
    """A key without surrounding white space, case and kind prefix; null if nothing is left."""
    k = F.lower(strip(c))
    return F.nullif(strip(F.when(k.startswith("t1_") | k.startswith("t3_"), F.substr(k, F.lit(4))).otherwise(k)), F.lit(""))


def norm_symbol(c: Column) -> Column:
    """A symbol trimmed, without leading ``$``, in upper case, with ``-`` and ``/`` read as ``.``; null if nothing is left."""
    s = F.upper(strip(F.ltrim(strip(c), F.lit("$"))))
    return F.nullif(F.translate(s, "-/", ".."), F.lit(""))


def day_of(epoch: Column) -> Column:
    """The UTC day of epoch seconds, whatever the session's zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(epoch / F.lit(86400)).cast("int"))
