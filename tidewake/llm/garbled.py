"""Text decoded with the wrong character encoding (problem 10): found, and restored where it still can be.

1. Pieces. Each distinct text gives its passages and tokens with non-ASCII characters; both are counted by text, so
   that copies make nothing at home in the corpus. A bounded model of what is at home comes from the tokens: counts of
   characters and of hashed pairs of neighbours.
2. Twins. Passages are joined on their text without non-ASCII characters (case and numbers set aside), and on that text
   with a mark for each such character, which single-byte confusions keep: each variant with the variant that most
   texts hold, never variants among each other.
3. Alignment. The ASCII remainder anchors the non-ASCII runs of both twins; of two runs the one less at home is the
   garbled one, and the pair votes for every confusion of encodings (written in one, read in another) that explains
   it. Confusions that explain most are learned greedily. Confusions of two single-byte encodings, which any text would
   survive, are used only if learned so. Those that must pass the strict structure of a multi-byte encoding are tried
   even if unlearned, as Shift-JIS puts ASCII into the text and leaves it without a twin.
4. Application. The tokens of a batch are undone round by round, until nothing changes: forms that come out of UTF-8
   structure go on by any confusion, others as long as each round makes them more at home. The model screens forms,
   then an exact look-up decides: an undoing counts if the words it gives are at home and those it takes away are not.
5. A document is garbled if a token of it is, or if it holds the replacement character of a failed decoding.

Vocabulary, tokens and candidates are distributed tables joined by equality. The driver sees votes by set of
confusions, which the table of encodings bounds, and the model: at most one number per character of Unicode and
``BUCKETS`` numbers for pairs.

Cases: null, empty and pure ASCII text is never garbled; unusual but correct characters (box drawing, ligatures,
combining marks, mathematical signs, NBSP) stand for themselves; repeated documents are each found; a text of any
length is read whole; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import re
import string
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.session import materialise, spread

MULTI = ("utf-8", "cp932", "euc_jp", "gbk", "big5")
SINGLE = ("cp1252", "cp1251", "cp1250", "koi8-r", "cp866", "cp437", "cp850", "mac_roman")
READ_AS = ("cp1252", "latin-1", "cp1251", "cp1250", "cp1254", "cp1253", "cp1257", "iso8859-2", "koi8-r", "cp866", "cp437", "cp850", "mac_roman", "gbk", "big5", "cp932")
#: Every confusion: written in the first, read as the second.
CONFUSIONS = tuple((w, r) for w in (*MULTI, *SINGLE) for r in READ_AS if w != r)
#: Distinct pairs of runs that teach a confusion; texts that make a word at home; how many times as frequent restored words must be.
LESSONS, HOME, RATIO = 2, 3, 4.0
#: Counters of the model of neighbouring characters.
BUCKETS = 1 << 20
LOST = "�"
NUMBER = r"[0-9][0-9,.]*"
_BLANK = " \\t\\r\\n\\f"
#: A whole token (what stands between blanks) that holds a non-ASCII character.
_TOKEN = rf"(?<![^{_BLANK}])[\x00-\x7f&&[^{_BLANK}]]*+[^\x00-\x7f][^{_BLANK}]*+"
_MULTIBYTE = frozenset(MULTI)
_CONTROLS = re.compile("[\x80-\x9f]")
_LOW = re.compile("[\x00-\x1f]")


@lru_cache(None)
def _letters(encoding: str) -> str:
    """The 256 letters of a single-byte encoding; bytes it leaves undefined stand for the control characters of their number."""
    return "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in range(256))


@lru_cache(None)
def _bytes(encoding: str, controls: bool) -> object:
    """From letters to bytes; ``controls``: those that a kin of the encoding leaves undefined are among them."""
    if not controls:
        return codecs.charmap_build(_letters(encoding))
    return {b: b for b in range(0x80, 0xA0)} | {ord(c): b for b, c in enumerate(_letters(encoding))}


def encode(text: str, encoding: str) -> bytes | None:
    """Bytes of ``text``; null if the encoding lacks a character of it."""
    multi = encoding in _MULTIBYTE
    try:
        return text.encode(encoding) if multi else codecs.charmap_encode(text, "strict", _bytes(encoding, False))[0]
    except UnicodeEncodeError:
        if not _CONTROLS.search(text):
            return None
    if not multi:
        try:
            return codecs.charmap_encode(text, "strict", _bytes(encoding, True))[0]
        except UnicodeEncodeError:
            return None
    out = bytearray()
    for c in text:
        try:
            out += c.encode(encoding)
        except UnicodeEncodeError:
            if not "\x7f" < c < "\xa0":
                return None
            out.append(ord(c))
    return bytes(out)


def decode(data: bytes, encoding: str) -> str | None:
    if encoding not in _MULTIBYTE:
        return codecs.charmap_decode(data, "strict", _letters(encoding))[0]
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return None


def undo(text: str, written: str, read: str) -> str | None:
    """What ``text`` was before it was written in one encoding and read in another; null if it can't have been."""
    data = encode(text, read)
    out = None if data is None else decode(data, written)
    return None if out is None or out == text else out


def _confuse(text: str, written: str, read: str) -> str | None:
    data = encode(text, written)
    return None if data is None else decode(data, read)


# --- pieces and the model ------------------------------------------------------------------------------------------


def texts(documents: DataFrame) -> DataFrame:
    """``text``: each text with non-ASCII characters once, so that copies make nothing at home in the corpus."""
    return documents.where(F.col("text").rlike(r"[^\x00-\x7f]")).select("text").distinct()


def _passages() -> Column:
    # the case of other letters is kept: a confusion of encodings may well turn it
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(F.regexp_replace(low, NUMBER, "0"), r"\n+|(?<=[.!?]) +"), lambda p: p.rlike(r"[^\x00-\x7f]"))


def _tokens() -> Column:
    return F.array_distinct(F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0)))


def pieces(documents: DataFrame) -> DataFrame:
    """``whole, piece, n``: passages (``whole``, numbers masked) and tokens with non-ASCII characters, by number of distinct texts."""
    both = F.concat(F.transform(F.array_distinct(_passages()), lambda p: F.struct(F.lit(True).alias("whole"), p.alias("piece"))), F.transform(_tokens(), lambda t: F.struct(F.lit(False).alias("whole"), t.alias("piece"))))
    return texts(documents).select(F.inline(both)).groupBy("whole", "piece").agg(F.count(F.lit(1)).alias("n"))


def tokens(documents: DataFrame) -> DataFrame:
    """``doc_id, token``: the distinct tokens with non-ASCII characters of each document."""
    return documents.where("text is not null").select("doc_id", F.explode(_tokens()).alias("token"))


def _codes(strings: list[str]) -> np.ndarray:
    """Code points of strings, ASCII letters in lower case, a blank before, between and after the strings."""
    # the case of other letters is kept: a confusion of encodings may well turn it
    codes = np.frombuffer(f" {' '.join(strings)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return codes + 32 * ((codes >= 65) & (codes <= 90))


def _pairs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the pairs of neighbours that hold a non-ASCII character, and the string each belongs to."""
    a, b = codes[:-1], codes[1:]
    at = (a > 127) | (b > 127)
    return (a[at] * 0x9E3779B1 + b[at] * 0x85EBCA6B >> 7) % BUCKETS, (np.cumsum(codes == 32)[:-1] - 1)[at]


class Model:
    """How often characters and hashed pairs of neighbours occur, by distinct text."""

    def __init__(self, chars: dict[int, int], pairs: tuple[np.ndarray, np.ndarray]) -> None:
        low: Counter[str] = Counter()
        for c, n in chars.items():
            low[chr(c).lower()] += n
        self.common = frozenset(c for c, n in low.items() if n >= HOME)
        self.log = np.zeros(BUCKETS, np.float32)
        self.log[pairs[0]] = np.log1p(pairs[1])

    def score(self, strings: list[str]) -> np.ndarray:
        """How much at home each string is: the mean over its pairs."""
        if not strings:
            return np.zeros(0)
        at, whose = _pairs(_codes(strings))
        return np.bincount(whose, self.log[at], len(strings)) / np.maximum(np.bincount(whose, minlength=len(strings)), 1)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Characters (negative numbers) and pairs of the tokens of a partition, each with its number of texts."""
    total = np.zeros(BUCKETS, np.int64)
    chars: Counter[int] = Counter()
    for pdf in batches:
        if not len(pdf):
            continue
        codes = _codes(pdf["token"].tolist())
        n = pdf["n"].to_numpy(np.int64)
        at, whose = _pairs(codes)
        np.add.at(total, at, n[whose])
        other = codes > 127
        # a character counts once per token, however often it stands there
        one = np.unique((np.cumsum(codes == 32) - 1)[other] << 21 | codes[other])
        c, back = np.unique(one & (1 << 21) - 1, return_inverse=True)
        for k, m in zip(c.tolist(), np.bincount(back, n[one >> 21]).tolist()):
            chars[k] += int(m)
    at = np.flatnonzero(total)
    yield pd.DataFrame({"k": np.concatenate((at, -np.fromiter(chars.keys(), np.int64, len(chars)))), "n": np.concatenate((total[at], np.fromiter(chars.values(), np.int64, len(chars))))})


def model_of(counted: DataFrame) -> Model:
    """The model of a table of tokens. Its rows are at most BUCKETS and the characters of Unicode, whatever the corpus."""
    got = counted.mapInPandas(_count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    k, n = got["k"].to_numpy(np.int64), got["n"].to_numpy(np.int64)
    return Model(dict(zip((-k[k < 0]).tolist(), n[k < 0].tolist())), (k[k >= 0], n[k >= 0]))


# --- twins ---------------------------------------------------------------------------------------------------------


def runs_by_anchor(passage: str) -> dict[int, str]:
    """Non-ASCII runs of a passage by the number of ASCII characters before them."""
    out: dict[int, str] = {}
    seen = 0
    for ascii_, other in re.findall(r"([\x00-\x7f]+)|([^\x00-\x7f]+)", passage):
        if other:
            out[seen] = other
        seen += len(ascii_)
    return out


@lru_cache(200_000)
def explained(garbled: str, clean: str) -> str:
    """The confusions (their places in CONFUSIONS) that turn ``clean`` into ``garbled``; none if both are misread UTF-8."""
    if all(any(undo(x, "utf-8", r) is not None for r in READ_AS) for x in (garbled, clean)):
        return ""
    return ",".join(str(i) for i, (w, r) in enumerate(CONFUSIONS) if _confuse(clean, w, r) == garbled)


def _align(model: Callable[[], Model]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def at_home(passage: str) -> float:
        return float(model().score([t for t in passage.split(" ") if not t.isascii()]).mean())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = set()
            for variant, top, even in zip(pdf["passage"], pdf["top"], pdf["even"]):
                # what more texts hold is clean; of two as frequent, the one more at home
                clean, bad = (variant, top) if even and at_home(variant) > at_home(top) else (top, variant)
                a, b = runs_by_anchor(bad), runs_by_anchor(clean)
                for at in a.keys() & b.keys():
                    if a[at] != b[at] and (by := explained(a[at], b[at])):
                        out.add((by, a[at], b[at]))
            yield pd.DataFrame(sorted(out), columns=["by", "garbled", "clean"])

    return run


def lessons(passages: DataFrame, model: Callable[[], Model]) -> DataFrame:
    """``by, n``: how many distinct pairs of aligned runs each set of confusions explains."""
    other = r"[^\x00-\x7f]"
    rest = F.regexp_replace("passage", other, "")
    # two passages of one hash by chance cost a vain alignment, nothing else
    keys = F.array(F.when(F.length(rest) >= 6, F.xxhash64(rest, F.lit("rest"))), F.xxhash64(F.regexp_replace("passage", other, "\x01")))
    keyed = passages.select("passage", "n", F.explode(keys).alias("h")).where("h is not null")
    twins = keyed.join(keyed.groupBy("h").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1").select("h"), "h", "left_semi")
    tops = twins.groupBy("h").agg(F.max(F.struct("n", "passage")).alias("t")).select("h", F.col("t.passage").alias("top"), F.col("t.n").alias("most"))
    pairs = twins.join(tops, "h").where("passage <> top").select("passage", "top", (F.col("n") == F.col("most")).alias("even"))
    return pairs.mapInPandas(_align(model), "by string, garbled string, clean string").distinct().groupBy("by").agg(F.count(F.lit(1)).alias("n"))


def learn(votes: list[tuple[str, int]], least: int = LESSONS) -> list[tuple[str, str]]:
    """The fewest confusions that explain the aligned runs: most votes first, what it explains set aside, until too few are left."""
    left = {frozenset(map(int, by.split(","))): n for by, n in votes}
    out = []
    while True:
        tally: Counter[int] = Counter()
        for by, n in left.items():
            for i in by:
                tally[i] += n
        if not tally or (best := max(tally, key=lambda i: (tally[i], -i))) is None or tally[best] < least:
            return out
        out.append(CONFUSIONS[best])
        left = {by: n for by, n in left.items() if best not in by}


# --- tokens --------------------------------------------------------------------------------------------------------


def keys_of(token: str) -> set[str]:
    """Vocabulary keys: words (letters and non-ASCII), non-ASCII runs between CJK stops, and the token with numbers masked."""
    t = token.lower()
    out = {"w" + w for w in re.findall(r"[a-z\u0080-\U0010ffff]+", t) if not w.isascii()}
    out |= {"r" + r for r in re.findall(r"[^\x00-\x7f、。]+", t)}
    return out | {"m" + re.sub(NUMBER, "0", t)}


def telling(token: str) -> bool:
    """Whether a single-byte confusion shows in this token by itself: it has letters beside the sign, or a number, or two signs."""
    return len(re.findall(r"[^\x00-\x7f]", token)) > 1 or re.search(r"[A-Za-z0-9]", token) is not None


def vocabulary(counted: DataFrame) -> DataFrame:
    """``key, n``: in how many distinct texts (by token) each word and run occurs."""
    t = F.lower("token")

    def tagged(tag: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda w: w.rlike(r"[^\x00-\x7f]")), lambda w: F.concat(F.lit(tag), w))

    keys = F.array_distinct(F.concat(tagged("w", F.split(t, r"[^a-z\x{80}-\x{10ffff}]+")), tagged("r", F.split(t, r"[\x00-\x7f、。]+")), F.array(F.concat(F.lit("m"), F.regexp_replace(t, NUMBER, "0")))))
    return counted.select("n", F.explode(keys).alias("key")).groupBy("key").agg(F.sum("n").alias("n"))


@lru_cache(None)
def _stretches(read: str) -> tuple[re.Pattern[str], re.Pattern[str]]:
    """In text read in a single-byte encoding: one character in UTF-8, and any stretch of non-ASCII characters it has."""
    have = _letters(read)

    def among(lo: int, hi: int) -> str:
        return "[" + "".join(re.escape(have[b]) + (chr(b) if b < 0xA0 else "") for b in range(lo, hi + 1)) + "]"

    more = among(0x80, 0xBF)
    return re.compile(f"{among(0xC2, 0xDF)}{more}|{among(0xE0, 0xEF)}{more}{{2}}|{among(0xF0, 0xF4)}{more}{{3}}"), re.compile(among(0x80, 0xFF) + "{2,}")


class Tries:
    """Which confusions to try, by the encoding read in: on tokens with one non-ASCII character, and with several.

    A text in UTF-8 that was read in a single-byte encoding shows two characters at least. A confusion that is not
    learned needs two as well, as a letter with an accent and the one after it often make up some double byte.
    """

    def __init__(self, learned: list[tuple[str, str]] | tuple[tuple[str, str], ...]) -> None:
        tried = [c for c in CONFUSIONS if c[0] in _MULTIBYTE or c in learned]
        one = [(w, r) for w, r in tried if w in SINGLE or (r in _MULTIBYTE if w == "utf-8" else (w, r) in learned)]
        self.one, self.more = ({r: [w for w, x in some if x == r] for r in dict.fromkeys(x for _, x in some)} for some in (one, tried))


def earlier(token: str, tries: Tries) -> Iterator[tuple[str, str]]:
    """What a token may have been one confusion ago, with the encoding it was written in."""
    signs = len(token) - len(token.encode("ascii", "ignore"))
    tells = telling(token)
    lacking = []
    vouched = False
    for read, written in (tries.one if signs == 1 else tries.more).items():
        data = encode(token, read)
        if data is None:
            if "utf-8" in written and read not in _MULTIBYTE:
                lacking.append(read)
            continue
        for w in written:
            if (tells or w in _MULTIBYTE) and (got := decode(data, w)) is not None and got != token and not _LOW.search(got):
                vouched |= w == "utf-8"
                yield got, w
    if vouched:
        return
    # what no encoding has stays as it is: only the stretches that are UTF-8 are undone, by the reading that finds most
    parts = set()
    for read in lacking:
        one, stretch = _stretches(read)
        if one.search(token):
            got = stretch.sub(lambda m: one.match(m[0]) and undo(m[0], "utf-8", read) or m[0], token)
            if got != token and not _LOW.search(got):
                parts.add(got)
    most = min(map(len, parts), default=0)
    for got in sorted(parts):
        if len(got) == most:
            yield got, "utf-8"


def undoings(strings: list[str], tries: Tries, model: Model) -> list[tuple[str, str, str]]:
    """Token, earlier form and the weakest structure on the way (``utf-8``, ``other`` or ``single``), until nothing changes.

    A form out of UTF-8 structure is shorter than what it came from, and any other must be more at home than that, so
    that the rounds come to an end.
    """
    out: list[tuple[str, str, str]] = []
    seen: set[tuple[str, str]] = set()
    level = [(t, t, "utf-8") for t in strings]
    while level:
        new: list[tuple[int, str, str]] = []
        for i, (token, form, kind) in enumerate(level):
            have = set(form)
            for got, w in earlier(form, tries):
                k = "single" if kind == "single" or w in SINGLE else "utf-8" if w == kind == "utf-8" else "other"
                if (token, got) in seen or got == token:
                    continue
                if k != "utf-8":
                    won = [c in model.common or c.lower() in model.common for c in set(got) - have if c > "\x7f"]
                    if 2 * sum(won) < len(won):
                        continue
                seen.add((token, got))
                new.append((i, got, k))
        was = model.score([x[1] for x in level])
        up = model.score([x[1] for x in new]) > was[np.fromiter((x[0] for x in new), np.int64, len(new))]
        nxt = [(level[i][0], got, k) for (i, got, k), better in zip(new, up) if better or k == "utf-8"]
        out += nxt
        level = [x for x in nxt if not x[1].isascii()]
    return out


def _candidates(learned: list[tuple[str, str]], model: Callable[[], Model]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries = Tries(learned)
        for pdf in batches:
            out = []
            for token, form, kind in undoings(pdf["token"].tolist(), tries, model()):
                old, new = keys_of(token), keys_of(form)
                letters = {c for c in form.lower() if c > "\x7f"} - set(token.lower())
                home = sum(c in model().common for c in letters) / max(len(letters), 1)
                out.append((token, form, kind, home, len(letters), LOST in letters, sorted(old - new), sorted(new - old)))
            yield pd.DataFrame(out, columns=["token", "form", "kind", "letters", "n_letters", "lossy", "lost", "won"])

    return run


def garbled_tokens(documents: DataFrame) -> DataFrame:
    """``token, form``: every garbled token with what it was (the best undoing)."""
    return _judged(documents)[0]


def _judged(documents: DataFrame) -> tuple[DataFrame, DataFrame, list[tuple[str, str]]]:
    """Garbled tokens with their forms; all tokens with the number of distinct texts they are in; the confusions learned."""
    found = materialise(pieces(documents))
    counted = found.where("not whole").select(F.col("piece").alias("token"), "n")
    sent = documents.sparkSession.sparkContext.broadcast(model_of(counted))
    model = lambda: sent.value
    passages = found.where("whole").select(F.col("piece").alias("passage"), "n")
    learned = learn([(x.by, x.n) for x in lessons(passages, model).collect()])
    cand = spread(counted.select("token"), "token").mapInPandas(_candidates(learned, model), "token string, form string, kind string, letters double, n_letters long, lossy boolean, lost array<string>, won array<string>")
    # only a number goes with each key; the texts stay behind
    cand = materialise(cand.withColumn("c", F.xxhash64("token", "form")))
    side = F.explode(F.concat(F.transform("lost", lambda k: F.struct(k.alias("key"), F.lit(False).alias("won"))), F.transform("won", lambda k: F.struct(k.alias("key"), F.lit(True).alias("won")))))
    looked = cand.select("c", side.alias("x")).select("c", "x.*").join(vocabulary(counted), "key", "left")
    n, tag = F.coalesce("n", F.lit(0)), F.substr("key", F.lit(1), F.lit(1))

    def level(side: Column, t: Column) -> Column:
        return F.coalesce(F.avg(F.when(side & t, F.log1p(n))), F.lit(0.0))

    def share(t: Column) -> Column:
        return F.coalesce(F.avg(F.when(F.col("won") & t, (n >= HOME).cast("double"))), F.lit(0.0))

    def rise(tag_: str) -> Column:
        return level(F.col("won"), tag == tag_) - level(~F.col("won"), tag == tag_)

    scored = looked.groupBy("c").agg(rise("w").alias("words"), share(tag == "w").alias("known"), rise("r").alias("runs"), share(tag == "r").alias("known_runs"), rise("m").alias("masks"), share(tag == "m").alias("known_masks"))
    home = (F.col("known") >= 0.75) & (F.col("words") >= F.log(F.lit(RATIO)))
    home_runs = (F.col("known_runs") >= 0.75) & (F.col("runs") >= F.log(F.lit(RATIO)))
    strong = (F.col("kind") == "utf-8") & (F.col("lossy") | (F.col("letters") == 1) & (F.col("n_letters") >= 2))
    shape = (F.col("known_masks") == 1) & (F.col("masks") >= F.log(F.lit(RATIO)))
    single = F.col("kind") == "single"
    good = cand.drop("lost", "won").join(scored, "c", "left").where(strong | F.when(single, home & (shape | F.col("token").rlike("[A-Za-z]"))).otherwise(home | home_runs)).withColumn("score", F.col("words") + F.col("known") + F.col("letters"))
    return good.groupBy("token").agg(F.max_by("form", F.struct("score", "form")).alias("form")), counted, learned


def garbled_documents(documents: DataFrame) -> DataFrame:
    """``doc_id`` of every document with a garbled passage, restorable or not."""
    lost = documents.where(F.contains("text", F.lit(LOST))).select("doc_id")
    return tokens(documents).join(garbled_tokens(documents).select("token"), "token").select("doc_id").unionByName(lost).distinct()


Way = tuple[tuple[str, str], ...]


@lru_cache(100_000)
def ways(token: str, form: str, learned: tuple[tuple[str, str], ...]) -> frozenset[Way]:
    """The shortest ways from a token to its form: confusions undone one after the other."""
    usable = [c for c in CONFUSIONS if c[0] in MULTI or c in learned]
    level: dict[str, list[Way]] = {token: [()]}
    seen = {token}
    while level:
        nxt: dict[str, list[Way]] = {}
        for t, before in level.items():
            for c in usable:
                if (got := undo(t, *c)) is not None and got not in seen:
                    # a form that no structure vouches for goes on by its own confusion only
                    nxt.setdefault(got, []).extend((*w, c) for w in before if not w or w[-1][0] == "utf-8" or w[-1] == c)
        if nxt.get(form):
            return frozenset(nxt[form])
        seen |= nxt.keys()
        level = {t: ws for t, ws in nxt.items() if ws and not t.isascii()}
    return frozenset()


def follow(token: str, way: Way) -> str | None:
    """A token after all undoings of a way (itself, where they change nothing); null if it can't have come that way."""
    for written, read in way:
        data = encode(token, read)
        if data is None or (got := decode(data, written)) is None:
            return None
        token = got
    return None if any(c < " " for c in token) else token


def restore_passage(passage: str, back: dict[str, str], often: set[str], learned: tuple[tuple[str, str], ...]) -> tuple[str, bool]:
    """A passage undone, and whether no token of it is left. The confusion is the one that most accepted tokens went by.

    Where ways that are as likely disagree, and where a single-byte confusion meets a token that is at home in the
    corpus as it is (``often``), the token is left.
    """
    here = [t for t in re.findall(r"[^ \t\r\n\f]+", passage) if not t.isascii()]
    hits = [t for t in set(here) if t in back]
    if not hits:
        return passage, LOST not in passage
    tally = Counter(w for t in hits for w in ways(t, back[t], learned))
    best = [w for w, n in tally.items() if n == max(tally.values())]
    best = [w for w in best if all(c in learned for c in w)] or best
    whole, new = True, {}
    for t in set(here):
        if t in back:
            new[t] = back[t]
            continue
        got = {x for w in best if not (t in often and any(c[0] in SINGLE for c in w)) and (x := follow(t, w)) is not None}
        if len(got) == 1:
            new[t] = got.pop()
        else:
            whole = False
    out = re.sub(r"[^ \t\r\n\f]+", lambda m: new.get(m[0], m[0]), passage)
    return out, whole and LOST not in out


def _restore(learned: tuple[tuple[str, str], ...]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, text, forms in zip(pdf["doc_id"], pdf["text"], pdf["forms"]):
                forms = [] if forms is None else forms
                back = {x["token"]: x["form"] for x in forms if x["form"] is not None}
                often = {x["token"] for x in forms if x["n"] >= 3}
                parts = [restore_passage(p, back, often, learned) for p in re.split(r"(\n+|(?<=[.!?]) +)", text)]
                out.append((doc_id, "".join(p for p, _ in parts), all(w for _, w in parts)))
            yield pd.DataFrame(out, columns=["doc_id", "text", "whole"])

    return run


def restored(documents: DataFrame) -> DataFrame:
    """``doc_id, text, whole`` of the garbled documents: their text as far as it could be recovered, and whether nothing is lost.

    The confusion of a passage's garbled tokens is undone in its other tokens too, however rare; ``whole`` is false
    where a token of such a passage could not be.
    """
    back, counted, learned = _judged(documents)
    forms = tokens(documents).join(counted.join(back, "token", "left"), "token").groupBy("doc_id").agg(F.collect_list(F.struct("token", "form", "n")).alias("forms")).where(F.exists("forms", lambda x: x["form"].isNotNull()))
    hit = documents.select("doc_id", "text").join(forms, "doc_id", "left").where(F.col("forms").isNotNull() | F.contains("text", F.lit(LOST)))
    return hit.mapInPandas(_restore(tuple(learned)), "doc_id long, text string, whole boolean")
