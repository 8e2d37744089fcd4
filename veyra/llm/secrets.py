"""Secrets in texts, by patterns and by sliding-window entropy; DataFrame functions only.

Matches come from the text split at them, so starts are sums of lengths (code points). For strings of secret-like
characters, the largest Shannon entropy of any window of 20 characters is kept up by incremental counts: each step
adds one character's count and takes one away. Strings on the allow list (one case of letters only, digits only, UUIDs,
words that are joined by signs or by capitals, rows of one sign) add no span. Patterns repeat single signs only, never
groups, so their depth doesn't grow with the text. A null text counts as empty; every row gives one row; columns named
base or spans are replaced, all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW = 20
#: The patterns, the group whose length counts and the least length, in the order of ties.
PATTERNS = [
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Least entropy in bits by class: what the string is made of.
CLASSES = [("hex digits", r"^[0-9A-Fa-f]+$", 3.0), ("letters and digits", r"^[A-Za-z0-9]+$", 3.6), ("base 64", r"^[A-Za-z0-9+/_=-]+$", 3.8)]
HEX4 = "[0-9a-fA-F]{4}"
ALLOWED = [r"^[a-z+/_=-]+$", r"^[A-Z+/_=-]+$", r"^[0-9+/_=-]+$", f"^{HEX4}{HEX4}-{HEX4}-{HEX4}-{HEX4}-{HEX4}{HEX4}{HEX4}$", r"^(.)\1+$"]
#: Words: letters and signs, where none of the second stands: a capital that two small letters don't follow, or signs side by side.
WORDS = (r"^[A-Za-z+/_=-]+$", r"[A-Z]([^a-z]|.?$|.[^a-z])|[+/_=-][+/_=-]")
SPAN = "array<struct<start:int,ord:int,end:int,kind:string>>"


def _spans(text: Column, pattern: str, group: int, least: int, kind: str, order: int, keep=None) -> Column:
    """Spans of the pattern's leftmost non-overlapping matches whose group has the least length."""
    between = F.transform(F.split(text, pattern, -1), F.length)
    whole, part = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.zip_with(between, whole, lambda g, w: F.struct(g.alias("gap"), F.length(w).alias("len"), w.alias("text")))
    facts = F.zip_with(pieces, part, lambda x, p: F.struct(x["gap"].alias("gap"), x["len"].alias("len"), x["text"].alias("text"), F.length(p).alias("own")))  # the last piece has no match

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        good = x["own"] >= least if keep is None else (x["own"] >= least) & keep(x["text"])
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), (start + x["len"]).alias("end"), F.lit(kind).alias("kind")))
        return F.struct(F.coalesce(start + x["len"], acc["at"]).alias("at"), F.when(F.coalesce(good, F.lit(False)), F.concat(acc["out"], one.cast(SPAN))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(facts, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def _signs(word: Column) -> Column:
    return F.slice(F.split(word, "(?!^)"), 1, F.length(word))  # the split ends with an empty string


def peak_entropy(word: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of window consecutive characters of an ASCII string at least that long."""
    codes = F.transform(_signs(word), F.ascii)

    def own(n: Column) -> Column:
        return F.when(n > 1, n * F.log2(n)).otherwise(0.0)

    def many(acc: Column, c: Column) -> Column:
        return F.size(F.filter(acc["w"], lambda x: x == c))

    def step(acc: Column, new: Column) -> Column:
        full = F.size(acc["w"]) >= window
        old = F.when(full, F.get(acc["w"], F.lit(0))).otherwise(-1)
        a = many(acc, new)
        b = F.when(full, many(acc, old) + (old == new).cast("int")).otherwise(0)
        s = acc["s"] - own(a) + own(a + 1) - own(b) + own(F.greatest(b - 1, F.lit(0)))
        w = F.concat(F.when(full, F.slice(acc["w"], 2, window - 1)).otherwise(acc["w"]), F.array(new))
        h = F.when(F.size(w) >= window, F.log2(F.lit(float(window))) - s / window).otherwise(0.0)
        return F.struct(w.alias("w"), s.alias("s"), F.greatest(acc["best"], h).alias("best"))

    start = F.struct(F.array().cast("array<int>").alias("w"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))
    return F.aggregate(codes, start, step, lambda acc: acc["best"])


def suspicious(word: Column) -> Column:
    """Not on the allow list, and over the entropy of its class."""
    allowed = F.lit(False)
    for p in ALLOWED:
        allowed = allowed | word.rlike(p)
    allowed = allowed | (word.rlike(WORDS[0]) & ~word.rlike(WORDS[1]))
    least = F.coalesce(*[F.when(word.rlike(p), v) for _, p, v in CLASSES])
    kinds = F.size(F.array_distinct(_signs(word)))  # n kinds of signs hold log2(n) bits at most
    return F.when(allowed | (F.log2(kinds) < least - 1e-9), False).otherwise(peak_entropy(word) >= least)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with base and spans, arrays of (start, ord, end, kind) in order; columns of these names are replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = [_spans(text, p, g, n, kind, i) for i, (kind, p, g, n) in enumerate(PATTERNS)]
    more = _spans(text, CANDIDATE, 0, WINDOW, "entropy", len(PATTERNS), suspicious)
    base = F.array_sort(F.concat(*found))
    return docs.withColumns({"base": base, "spans": F.array_sort(F.concat(base, more))})


def _of(kind: str) -> Column:
    return F.filter("base", lambda x: x["kind"] == kind)


def _joined(name: str) -> Column:
    return F.array_join(F.transform(name, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(_of(k)).cast("long").alias(f"n_{k}") for k, *_ in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
