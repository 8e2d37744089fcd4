"""Removal of repeated byte strings with suffix arrays by two-stage sorting.

Any two equal strings of LENGTH bytes choose the same anchor (the least K-byte hash inside them) at the same place, so
suffixes that share LENGTH bytes meet in the bucket of their anchor. Anchors whose hash stands once in the corpus leave
early; the others carry the bytes around them. Equal surroundings are merged with their number before they meet, so
many copies cost one row; ranges of anchor hashes are the buckets. In a bucket the surroundings are joined with unique
separators, the suffixes that are smaller than their successors are sorted directly, the others are induced by bucket
scans, and adjacent common prefixes of LENGTH bytes show the repeated strings. Texts equal as a whole are one text, all
of whose bytes go where it is long enough. Hashes only choose what meets; bytes decide. A null text is empty; texts
shorter than LENGTH stay; rows with equal ids and texts count as two places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, text_batches

LENGTH, K, CHUNK, BUCKET = 200, 50, 1 << 20, 1 << 16
#: An anchor at so many places is split by the bytes beside it.
HOT = 2000
BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return tuple(np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(n - 1, b, np.uint64)))) for b in (BASE, inverse))


UP, DOWN = _powers(CHUNK + LENGTH)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position, hash, and first and last start of the strings of LENGTH bytes that choose each anchor."""
    out = [[], [], [], []]
    for at in range(0, max(0, len(data) - LENGTH + 1), CHUNK):
        part = data[at : at + CHUNK + LENGTH - 1]
        n = len(part)
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * UP[:n])))
            h = (sums[K:] - sums[:-K]) * DOWN[: n - K + 1]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        key = (h & ~np.uint64((1 << 21) - 1)) | np.arange(len(h), dtype=np.uint64)  # leftmost at ties
        w = LENGTH - K + 1
        whole = -(-len(key) // w) * w
        padded = np.concatenate((key, np.full(whole - len(key), np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
        before = np.minimum.accumulate(padded, axis=1).ravel()
        after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = n - LENGTH + 1
        chosen = (np.minimum(after[:starts], before[w - 1 : w - 1 + starts]) & np.uint64((1 << 21) - 1)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        last = np.concatenate((edge[1:], [starts])) - 1
        for x, v in zip(out, (chosen[edge] + at, h[chosen[edge]].view(np.int64), edge + at, last + at)):
            x.append(v)
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in out)


def suffix_array(data: bytes) -> list[int]:
    """Two-stage sorting: suffixes smaller than their successors directly, the rest by a scan of buckets.

    Direct comparison reads LENGTH + 56 bytes; beyond that, order doesn't change common prefixes of LENGTH bytes."""
    n = len(data)
    a = np.frombuffer(data, np.uint8)
    # smaller than the successor: the first different byte after a run decides; the last suffix is larger
    change = np.flatnonzero(a[:-1] != a[1:])
    nearest = np.searchsorted(change, np.arange(n))
    rising = np.concatenate((a[change] < a[change + 1], [False])) if len(change) else np.array([False])
    smaller = rising[nearest]
    sizes = np.bincount(a, minlength=256)
    head = np.concatenate(([0], np.cumsum(sizes)))[:256].tolist()
    direct = sorted(np.flatnonzero(smaller).tolist(), key=lambda i: data[i : i + LENGTH + 56])
    order = [-1] * n
    tail = [h + int(s) for h, s in zip(head, sizes)]
    for i in reversed(direct):  # within a first byte, those smaller than their successors come last
        tail[data[i]] -= 1
        order[tail[data[i]]] = i
    large = (~smaller).tolist()
    c = data[n - 1]
    order[head[c]] = n - 1
    head[c] += 1
    for k in range(n):  # a scan from the left: a larger suffix follows its successor
        i = order[k] - 1
        if i >= 0 and large[i]:
            c = data[i]
            order[head[c]] = i
            head[c] += 1
    return order


def repeated(pieces: list[tuple[bytes, int, int, int]]) -> list[np.ndarray]:
    """For pieces (bytes, first and last start, number of places): which of the starts have their LENGTH bytes elsewhere too."""
    flags = [np.zeros(last - first + 1, bool) if many < 2 else np.ones(last - first + 1, bool) for _, first, last, many in pieces]
    data = b"".join(p[0] for p in pieces)
    if len(pieces) == 1 or not data:
        return flags
    piece_of, start_of = np.repeat(np.arange(len(pieces)), [len(p[0]) for p in pieces]), np.cumsum([0, *(len(p[0]) for p in pieces)])
    order = np.array(suffix_array(data))
    inside = order - start_of[piece_of[order]]
    first, last = np.array([p[1] for p in pieces])[piece_of[order]], np.array([p[2] for p in pieces])[piece_of[order]]
    keep = (inside >= first) & (inside <= last)
    order, inside, first = order[keep], inside[keep], first[keep]
    heads = [data[i : i + LENGTH] for i in order.tolist()]  # common prefixes with the neighbour, up to LENGTH
    for k in range(1, len(heads)):
        if heads[k] == heads[k - 1]:
            for x in (k - 1, k):
                flags[piece_of[order[x]]][inside[x] - first[x]] = True
    return flags


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An anchor's hash, the first start that chooses it, and how far the anchor and the last such start lie behind it."""
    def put(keys: list[bytes], parts: list[tuple]) -> pa.RecordBatch:
        h, first, fit = (np.concatenate(c) if parts else np.empty(0, np.int64) for c in (zip(*parts) if parts else ((), (), ())))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(h, pa.int64()), pa.array(first, pa.int64()), pa.array(fit, pa.int32())], names=["key", "h", "a", "fit"])

    keys, parts = [], []
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            pos, h, first, last = anchors(np.frombuffer(text.encode(), np.uint8))
            if len(pos):
                keys.extend([key] * len(pos))
                parts.append((h, first, ((pos - first) << 8 | (last - first)).astype(np.int32)))
            if len(keys) >= 20_000:
                yield put(keys, parts)
                keys, parts = [], []
    yield put(keys, parts)


def _split(data: bytes, h: int, a: int, span: int, off: int, hot: bool) -> list[tuple[int, int, int]]:
    """(bucket, first and last start) of a place's strings. Those of a hot anchor go by the bytes that all of them hold
    besides it: strings that start at most half a free length before the anchor hold what follows it, the others what
    stands before. Equal strings start as far before the anchor, so they still meet."""
    if not hot:
        return [(h, 0, span)]
    half = (LENGTH - K) // 2
    edge = off - half  # starts from here on hold LENGTH - half bytes from the anchor on
    out = []
    if edge <= span:
        beside = data[a + off : a + off + LENGTH - half]
        out.append((int.from_bytes(hashlib.blake2b(beside, digest_size=8).digest(), "little", signed=True), max(0, edge), span))
    if edge > 0:
        beside = data[a + edge - 1 : a + off + K]  # the last start before the edge: all earlier ones hold these too
        out.append((int.from_bytes(hashlib.blake2b(b"-" + beside, digest_size=8).digest(), "little", signed=True), 0, min(span, edge - 1)))
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text, spots): the bytes around each spot of anchors that stand more than once."""
    rows: list[tuple] = []

    def put() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 6, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["key", "h", "a", "span", "off", "piece"])

    for batch in batches:
        for key, text, spots in zip(*(batch.column(i).to_pylist() for i in range(3))):
            data = text.encode()
            for s in spots:
                a, span, off = s["a"], s["fit"] & 255, s["fit"] >> 8
                rows.extend((key, h, a + lo, hi - lo, off - lo, data[a + lo : a + hi + LENGTH]) for h, lo, hi in _split(data, s["h"], a, span, off, s["hot"]))
            if len(rows) >= 5000:
                yield put()
                rows.clear()
    yield put()


def _sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, piece, span, off, n) in order of h, an anchor's pieces together: their repeated starts as bytes."""
    held: list[tuple] = []

    def done(rows: list[tuple]) -> pa.RecordBatch:
        # strings that are equal share an anchor, so a piece that is alone at its anchor has only its own copies
        alone = [(k == 0 or rows[k - 1][0] != r[0]) and (k + 1 == len(rows) or rows[k + 1][0] != r[0]) for k, r in enumerate(rows)]
        sorted_in = iter(repeated([(p, 0, span, n) for (_, p, span, _, n), one in zip(rows, alone) if not one]))
        flags = [np.full(r[2] + 1, r[4] > 1) if one else next(sorted_in) for r, one in zip(rows, alone)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows]), pa.array([f.tobytes() for f in flags], pa.binary())], names=["h", "piece", "span", "flags"])

    size = 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if size > BUCKET and row[0] != held[-1][0]:
                yield done(held)
                held, size = [], 0
            held.append(row)
            size += len(row[1])
    if held:
        yield done(held)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out = batch.column(0), []
        for text, many, found in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            data = (text or "").encode()
            starts = np.full(max(0, len(data) - LENGTH + 1), many > 1)
            for x in found or ():
                starts[x["a"] : x["a"] + len(x["flags"])] |= np.frombuffer(x["flags"], bool)
            gone = np.zeros(len(data), np.int32)
            gone[: len(starts)] += starts
            gone[LENGTH:] -= starts[: len(data) - LENGTH] if len(starts) else False
            hit = np.cumsum(gone) > 0
            edges = np.diff(np.concatenate(([0], hit.astype(np.int8))))
            out.append((len(data), int(hit.sum()), int((edges == 1).sum()), np.frombuffer(data, np.uint8)[~hit].tobytes()))
        n, r, s, kept = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of each row."""
    text_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("key"))
    long = rows.where(F.octet_length("text") >= LENGTH).select("key", "text")
    marks = materialize(long.mapInArrow(_marks, "key binary, h long, a long, fit int"), "marks")
    # two places at least: copies of a text give one place, and the hash of a place tells them apart
    place = F.xxhash64("key", "a")
    common = marks.groupBy("h").agg(F.min(place).alias("p"), F.max(place).alias("q"), (F.count("*") >= HOT).alias("hot")).where("p < q").select("h", "hot")
    common = materialize(common, "common")  # so that the adaptive join splits a hot anchor's marks
    spots = materialize(marks.join(common, "h").groupBy("key").agg(F.collect_set(F.struct("h", "a", "fit", "hot")).alias("spots")), "spots")
    # texts are shuffled twice only: here, copies merged in each task before, and for the result
    heads = long.dropDuplicates(["key"]).join(spots, "key").select("key", "text", "spots")
    pieces = materialize(heads.mapInArrow(_pieces, "key binary, h long, a long, span long, off long, piece binary"), "pieces")
    merged = pieces.groupBy("h", "piece", "span", "off").agg(F.count("*").alias("n"))
    order = merged.select("h", "piece", "span", "off", "n").repartitionByRange("h").sortWithinPartitions("h")
    flagged = materialize(order.mapInArrow(_sorted_buckets, "h long, piece binary, span long, flags binary").where(F.col("flags").contains(F.lit(b"\x01"))).select("h", F.xxhash64("piece").alias("p"), "span", F.octet_length("piece").alias("size"), "flags").dropDuplicates(["h", "p", "span", "size"]), "flags")
    placed = pieces.select("key", "a", "h", F.xxhash64("piece").alias("p"), "span", F.octet_length("piece").alias("size")).join(flagged, ["h", "p", "span", "size"])
    found = placed.groupBy("key").agg(F.collect_list(F.struct("a", "flags")).alias("found"))
    copies = long.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    facts = copies.join(found, "key", "full")
    return rows.join(facts, "key", "left").select("doc_id", "text", F.coalesce("many", F.lit(1)).alias("many"), "found").mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The same digest by a table of all strings, for tests."""
    from collections import Counter

    datas = [(t or "").encode() for t in texts]
    seen = Counter(hashlib.sha256(d[i : i + length]).digest() for d in datas for i in range(len(d) - length + 1))
    out = []
    for d in datas:
        hit = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[hashlib.sha256(d[i : i + length]).digest()] > 1:
                hit[i : i + length] = b"\x01" * length
        spans = sum(1 for i, x in enumerate(hit) if x and (i == 0 or not hit[i - 1]))
        out.append((len(d), sum(hit), spans, hashlib.sha256(bytes(c for c, x in zip(d, hit) if not x)).hexdigest()))
    return out
