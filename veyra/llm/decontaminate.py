"""Benchmark decontamination with Aho-Corasick automata over normalised items.

One automaton holds the windows of all items and every text is scanned once. Only a benchmark of more than max_chars
characters of windows gets further automata, one after the other, so what a task holds stays bounded whatever the
benchmark's size. Hits are mapped back to the original text as code points.
Null texts have no words; items without words are never found; rows with a null item_id carry the id ""; empty tables
give empty results. Columns named n_words, hits, items, n_hit or contaminated are replaced, other columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from .common import table, text_batches

#: An automaton takes about 47 bytes for each character of windows (measured): 376 MB in a Python worker at this bound.
SIZE, MAX_CHARS = 13, 8_000_000
SPANS = ArrayType(StructType().add("a", "long").add("b", "long").add("start", "long").add("end", "long"))
#: ASCII letters in lower case, digits as they are, other ASCII as a space; bytes of other characters stay.
FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def places(text: str, runs: list[list[int]]) -> list[dict[str, int]]:
    """Runs of words (first, last) with where they start and end in the text, in code points, the end exclusive."""
    data = text.encode()
    words = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(FOLD))] if runs else []
    out, at, chars = [], 0, 0
    for a, b in runs:
        start = chars + len(data[at : words[a][0]].decode())
        end = start + len(data[words[a][0] : words[b][1]].decode())
        at, chars = words[b][1], end
        out.append({"a": a, "b": b, "start": start, "end": end})
    return out


def windows_of(words: list[bytes], size: int) -> list[bytes]:
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def automata(items: DataFrame, size: int, max_chars: int) -> Iterator[dict[str, list[str]]]:
    """Windows with the ids of their items, in parts of at most max_chars (or one item)."""
    part: dict[str, list[str]] = {}
    held = 0
    for row in items.toLocalIterator():
        mine = set(windows_of(words_of(row[1]), size))
        cost = sum(map(len, mine))
        if part and held + cost > max_chars:
            yield part
            part, held = {}, 0
        for w in mine:
            part.setdefault(w.decode(), []).append("" if row[0] is None else str(row[0]))
        held += cost
    yield part


def find(docs: DataFrame, items: DataFrame, *, size: int = SIZE, max_chars: int = MAX_CHARS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The columns of docs, n_words, hits (merged runs: first and last word from 0, start and end in the text) and items (array)."""
    text_batches(docs.sparkSession)
    out, schema = docs.drop("n_words", "hits", "items"), docs.drop("n_words", "hits", "items").schema
    names, at = schema.fieldNames(), schema.fieldNames().index(text_col)
    ddl = schema.add("n_words", "long").add("hits", SPANS).add("items", ArrayType(StringType()))
    more = pa.list_(pa.struct([(c, pa.int64()) for c in ("a", "b", "start", "end")]))
    for k, windows in enumerate(automata(items.select(item_col, text_col), size, max_chars)):
        sent = docs.sparkSession.sparkContext.broadcast(windows)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, first=k == 0) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for w, ids in sent.value.items():
                machine.add_word(f" {w} ", (w.count(" ") + 1, ids))
            machine.make_automaton()
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    counts, hits, found = [], [], []
                    old = [(set(), [])] * part.num_rows if first else zip(map(set, part.column(len(names) + 2).to_pylist()), part.column(len(names) + 1).to_pylist())
                    for text, (ids, spans) in zip(part.column(at).to_pylist(), old):
                        words = words_of(text)
                        line = f" {b' '.join(words).decode()} "
                        ids, spans = set(ids), [(x["a"], x["b"]) for x in spans]
                        done, word = 0, 0
                        if len(sent.value):
                            for end, (n, own) in machine.iter(line):
                                last = word + line.count(" ", done, end + 1) - 2  # spaces up to the closing one, less two
                                word, done = word + line.count(" ", done, end), end
                                spans.append((last - n + 1, last))
                                ids.update(own)
                        merged: list[list[int]] = []
                        for a, b in sorted(spans):
                            if merged and a <= merged[-1][1] + 1:
                                merged[-1][1] = max(b, merged[-1][1])
                            else:
                                merged.append([a, b])
                        counts.append(len(words))
                        hits.append(places(text, merged) if merged else [])
                        found.append(sorted(ids))
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(counts, pa.int64()), pa.array(hits, more), pa.array(found, pa.list_(pa.string()))], names=[*names, "n_words", "hits", "items"])

        out = out.mapInArrow(run, ddl)
    return out


#: The share of hit words from which a document counts as contaminated.
JUDGED = "aggregate(hits, 0L, (s, h) -> s + h.b - h.a + 1)"


def contaminated(found: DataFrame) -> DataFrame:
    return found.withColumn("n_hit", F.expr(JUDGED)).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def leaked(size: int = SIZE) -> Column:
    """Whether a row of contaminated() holds a run of benchmark text as long as a window, or is contaminated."""
    return F.col("contaminated") | F.exists("hits", lambda h: h["b"] - h["a"] + 1 >= size)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))
    return found.selectExpr("doc_id", "n_words", "n_hit", "cast(size(items) as long) n_items", "sha2(array_join(items, ','), 256) items_sha256", "contaminated")
