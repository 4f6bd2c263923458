"""Tokens, cashtags, withdrawn content and company names, with built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewake.functions.keys import WHITE, strip
from tidewake.schemas import WITHDRAWN

# What a cashtag is, and the characters stripped from a word's ends.
#: ``$`` and one to five letters, perhaps a class after a dot, ending at a word's end.
CASHTAG = r"(?U)\$([A-Za-z]{1,5})(?:\.([A-Za-z]))?\b"
EDGES = ".,!?:;()[]\"'"

# Words whose presence near a symbol makes it one.
CONTEXT_TERMS = """
call calls put puts share shares stock stocks ticker position positions
buy buying bought sell selling sold long short hold holding bag bags
strike expiry expiration leap leaps option options contract contracts
earnings squeeze dip rip moon bullish bearish yolo dd float shorted
premarket afterhours ipo split dividend div ath rsi macd support resistance
""".split()
WINDOW = 6

# Where a listed security's name ends, and the legal forms cut off it, each in order.
NAME_ENDS = (" common stock", " class a", " class b", " class c", " ordinary shares", " american depositary", " depositary shares", " warrant", " units", " preferred stock", " - ", " etf", " trust", " fund")
LEGAL_FORMS = (" inc.", " inc", " corp.", " corp", " corporation", " company", " co.", " co", " ltd.", " ltd", " plc", " l.p.", " lp", " holdings", " holding", " group", " international", " n.v.", " s.a.", " ag", " se", ",")


def is_withdrawn(*texts: Column) -> Column:
    """Whether any text is, but for white space, a mark of withdrawn content; null is not."""
    return reduce(lambda a, b: a | b, [F.coalesce(strip(t).isin(*WITHDRAWN), F.lit(False)) for t in texts])


def tokens(text: Column) -> Column:
    """Text cut at white space in the Unicode sense."""
    # one character to split at keeps the regular expressions out of it
    return F.filter(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), lambda t: t != "")


def bare(token: Column) -> Column:
    """A token without punctuation at its edges."""
    return F.btrim(token, F.lit(EDGES))


def cashtags(text: Column) -> Column:
    """Every cashtag of a text in upper case, class letter included, repeats kept."""
    tag, cls = F.regexp_extract_all(text, F.lit(CASHTAG), F.lit(1)), F.regexp_extract_all(text, F.lit(CASHTAG), F.lit(2))
    return F.zip_with(tag, cls, lambda t, c: F.upper(F.when(c == "", t).otherwise(F.concat(t, F.lit("."), c))))


def bare_lower(toks: Column) -> Column:
    """Tokens in lower case without punctuation at their edges."""
    return F.transform(toks, lambda t: bare(F.lower(t)))


def bare_symbols(toks: Column, lower: Column) -> Column:
    """Upper-case tokens of up to five letters: ``(symbol, near)``, near telling of a trading word within six tokens.

    ``lower`` is ``bare_lower`` of the tokens as a column of its own, so that it isn't made anew for every token.
    """

    def look(t: Column, i: Column) -> Column:
        around = F.slice(lower, F.greatest(i - WINDOW, F.lit(0)) + 1, F.least(i, F.lit(WINDOW)) + WINDOW + 1)
        clean = bare(t)
        return F.when(clean.rlike("^[A-Z]{1,5}$"), F.struct(clean.alias("symbol"), F.exists(around, lambda w: w.isin(*CONTEXT_TERMS)).alias("near")))

    return F.filter(F.transform(toks, look), lambda x: x.isNotNull())


def clean_company_name(name: Column) -> Column:
    """A security's name without instrument and legal boilerplate, in lower case."""
    ends, forms = (F.array(*[F.lit(x) for x in words]) for words in (NAME_ENDS, LEGAL_FORMS))

    def cut(low: Column, end: Column) -> Column:
        at = F.position(end, low)
        return F.when(at > 1, F.substr(low, F.lit(1), at - 1)).otherwise(low)

    def drop(low: Column, form: Column) -> Column:
        return F.when(F.endswith(low, form), F.substr(low, F.lit(1), F.length(low) - F.length(form))).otherwise(low)

    return F.btrim(F.aggregate(forms, F.aggregate(ends, F.lower(name), cut), drop), F.lit(" .,"))
