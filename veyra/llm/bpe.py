"""Byte-level BPE: distinct words are encoded by ranked merges over their bytes; decoding concatenates byte pieces.

A null text counts as empty and gives no ids. Documents are never shuffled: every task encodes the words that are
new to it and keeps them in a cache of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, text_batches

#: A task's cache holds so many words of at most so many characters.
CACHE_WORDS, LONGEST = 400_000, 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def fold_merges(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Merges the adjacent pair of the lowest rank, the leftmost at ties, until none is left; n log n in the word's length."""
    if word in ranks:
        return (ranks[word],)
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pairs = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(pairs)
    while pairs:
        _, i, size = heapq.heappop(pairs)
        if end[i] < 0 or (j := end[i]) >= n or end[j] - i != size:
            continue
        end[i], end[j] = end[j], -1
        if end[i] < n:
            before[end[i]] = i
        for a in (before[i], i):
            if a >= 0 and end[a] < n and (r := ranks.get(word[a : end[end[a]]])) is not None:
                heapq.heappush(pairs, (r, a, end[end[a]] - a))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return tuple(out)


def encode(docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_tokens, ids (binary, little-endian unsigned 32-bit) and decoded (binary, from the ids)."""
    text_batches(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))  # one vocabulary: a fixed size
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, rank, cache = regex.compile(pattern).findall, ranks.value, {}
        pieces = {v: k for k, v in rank.items()}
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                counts, ids, decoded = [], [], []
                for text in part.column(1).to_pylist():
                    out = array("I")
                    for word in find(text or ""):
                        got = cache.get(word)
                        if got is None:
                            if len(cache) >= CACHE_WORDS:
                                cache.clear()
                            got = fold_merges(word.encode(), rank)
                            if len(word) <= LONGEST:
                                cache[word] = got
                        out.extend(got)
                    counts.append(len(out))
                    ids.append(out.tobytes())
                    decoded.append(b"".join(map(pieces.__getitem__, out)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())],
                    names=["id", "n_tokens", "ids", "decoded"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens long, ids binary, decoded binary").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.selectExpr("doc_id", "n_tokens", "sha2(ids, 256) ids_sha256", "sha2(decoded, 256) decoded_sha256")
