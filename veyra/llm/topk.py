"""Exact top-k by inner product with block-at-a-time pruning.

Candidates are sorted, and runs of block_rows of them are the document-range blocks, each with a maximum and a minimum for
each term; runs of blocks make a tier above, which is one file of its blocks' forward index and bounds. Each query takes
tiers in its own order of their bounds (the summed best products of its weights with the extremes), one at first, then
rounds of ROUNDS times as many. In a round each tier is read once for all queries of a group that take it, and of its
blocks those are scored whose bound can still change a query's k-th hit, as one matrix product; a query ends when its next
bound cannot. A task reads the bounds of all tiers, and of the blocks of those tiers that a bound asks for. Products are of
32-bit floats where norms show that these are exact, else of 64-bit ones; of bytes, summed in 32-bit integers, where there
are EIGHT pairs, components fit and onnxruntime is there. Where bounds exclude nothing, as between vectors of unrelated
directions, all pairs are scored: such work grows with the square of the rows. Files are in the shared folder, so lost
executors lose nothing. Vectors that are null or empty, of another length than most, or hold null or non-finite
components take no part, nor do rows without vec_id. Extra columns are ignored; equal vec_ids are rows of their own, none of
which is its own hit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, table

HITS = "query_id long, rank int, vec_id long, score long"
#: Growth of a query's rounds; chunks of query_rows queries that share reads as a group; tiers in a partition.
ROUNDS, CHUNKS, TIERS = 8, 16, 4
#: Pairs from which products of 8 bits are worth loading their library.
EIGHT = 10**10


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


@cache
def _eight() -> Callable[[np.ndarray, np.ndarray], np.ndarray] | None:
    """The product of rows of components + 64, as bytes under 128, with columns of components from -127 to 127, as 32-bit
    integers: ONNX's MatMulInteger, where onnxruntime is there. Two such products fit 16 bits, so no kernel saturates."""
    try:
        import onnxruntime as ort
    except ImportError:
        return None

    def field(number: int, value: int | bytes) -> bytes:  # of a protocol buffer, lengths under 2**14
        if isinstance(value, int):
            return bytes([number << 3, value])
        return bytes([number << 3 | 2, len(value) % 128 | 128, len(value) // 128]) + value

    def matrix(name: bytes, kind: int) -> bytes:
        dims = b"".join(field(1, field(2, name + x)) for x in (b"r", b"c"))
        return field(1, name) + field(2, field(1, field(1, kind) + field(2, dims)))

    node = b"".join(field(1, x) for x in (b"q", b"m", b"z")) + field(2, b"s") + field(4, b"MatMulInteger")
    zero = field(2, 2) + field(8, b"z") + field(9, bytes([64]))  # uint8
    graph = field(1, node) + field(2, b"g") + field(5, zero) + field(11, matrix(b"q", 2)) + field(11, matrix(b"m", 3)) + field(12, matrix(b"s", 6))
    options = ort.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    model = field(1, 8) + field(7, graph) + field(8, field(1, b"") + field(2, 13))
    run = ort.InferenceSession(model, options, providers=["CPUExecutionProvider"]).run
    return lambda q, m: run(None, {"q": q, "m": np.ascontiguousarray(m)})[0]


def search(vectors: DataFrame, is_query: Column, *, k: int = 20, block_rows: int = 1024, tier_blocks: int = 8, query_rows: int = 256, cached: int = 64) -> DataFrame:
    """vectors: vec_id, v (array<double> of whole numbers). Each query's k best: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    path = shared_dir(spark, "blocks")
    sound = F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    signs = F.array_join(F.transform(F.slice("v", 1, 12), lambda x: F.when(x > 0, "1").otherwise("0")), "")
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select("vec_id", "v", is_query.alias("asks"), signs.alias("near"), F.size("v").alias("width"))
    rows = materialize(rows, "vectors")
    lengths = rows.groupBy("width").agg(F.count("*").alias("c"), F.count_if("asks").alias("asks")).orderBy(F.desc("c"), "width").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], HITS)
    rows, n, asks = rows.where(F.col("width") == lengths[0]["width"]), lengths[0]["c"], lengths[0]["asks"]
    cores = spark.sparkContext.defaultParallelism

    def parts(rows: int, most: int, least: int) -> int:
        """Partitions of most rows each; where these are few for the cores, of fewer rows, but not under least."""
        return max(1, -(-rows // most), min(3 * cores, -(-rows // least)))

    tier_rows, group = block_rows * tier_blocks, query_rows * CHUNKS
    ordered = rows.select("vec_id", "v", "near").repartitionByRange(parts(n, tier_rows * TIERS, tier_rows), "near", "vec_id").sortWithinPartitions("near", "vec_id")

    def runs(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
        left: list[pd.DataFrame] = []
        for f in frames:
            left.append(f)
            if sum(map(len, left)) >= size:
                whole = pd.concat(left)
                for i in range(0, len(whole) - size + 1, size):
                    yield whole.iloc[i : i + size]
                left = [whole.iloc[len(whole) - len(whole) % size :]]
        if sum(map(len, left)):
            yield pd.concat(left)

    def reach(m: np.ndarray) -> float:
        """The largest norm, where components are whole. Products of vectors stay exact as long as those of norms do."""
        return float(np.sqrt((m * m).sum(1)).max()) if (m == np.rint(m)).all() else np.inf

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A partition is a run of the order: its blocks, and one tier of their bounds for each tier_blocks of them."""
        import os

        store, base = _store(path)
        store.create_dir(f"{base}/index", recursive=True)
        for f in runs(frames, tier_rows):
            m, ids = np.array(f["v"].tolist(), dtype=np.float64), f["vec_id"].to_numpy(dtype=np.int64)
            with np.errstate(all="ignore"):
                size = reach(m)
                kind = next(t for t in (np.int8, np.int16, np.float32, np.float64) if (m.astype(t) == m).all() and (t is not np.int8 or m.min() > -128))
            starts = np.arange(0, len(m), block_rows)
            hi, lo, least = np.maximum.reduceat(m, starts), np.minimum.reduceat(m, starts), np.minimum.reduceat(ids, starts)
            name = os.urandom(12).hex()
            with store.open_output_stream(f"{base}/index/{name}") as out:
                for x in (ids, least, hi, lo, m.T.astype(kind)):
                    out.write(x.tobytes())
            yield pd.DataFrame({"tier": [name], "n": [len(m)], "kind": [np.dtype(kind).str], "reach": [size], "hi": [hi.max(0).tolist()], "lo": [lo.min(0).tolist()], "least": [int(ids.min())]})

    tiers = "tier string, n int, kind string, reach double, hi array<double>, lo array<double>, least long"
    ordered.select("vec_id", "v").mapInPandas(put, tiers).write.parquet(f"{path}/bounds")
    queries = rows.where("asks").select("vec_id", "v", "near").repartitionByRange(parts(asks, group, max(1, query_rows // 2)), "near", "vec_id").select("vec_id", "v")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from functools import lru_cache

        import pyarrow.parquet as pq

        store, base = _store(path)
        top = pq.read_table(f"{base}/bounds", filesystem=store).sort_by("least").to_pydict()  # equal bounds: least ids first
        top_hi, top_lo, top_least = np.array(top["hi"]), np.array(top["lo"]), np.array(top["least"], dtype=np.int64)
        space = {t: np.empty(query_rows * tier_rows, t) for t in (np.float32, np.float64)}
        eight = _eight() if n * asks >= EIGHT else None

        @lru_cache(max(1, cached * block_rows * len(top["n"]) // sum(top["n"])))
        def load(tier: int) -> tuple[np.ndarray, ...]:
            """Ids, each block's least id, maxima and minima, and the forward index, a column for each row."""
            n, width = top["n"][tier], top_hi.shape[1]
            blocks = -(-n // block_rows)
            with store.open_input_stream(f"{base}/index/{top['tier'][tier]}") as src:
                held = src.read()
            whole = np.frombuffer(held, np.int64, n + blocks)
            hi, lo = np.frombuffer(held, np.float64, 2 * blocks * width, whole.nbytes).reshape(2, blocks, width)
            m = np.frombuffer(held, top["kind"][tier], n * width, whole.nbytes + 2 * hi.nbytes).reshape(width, n)
            return whole[:n], whole[n:], hi, lo, m if eight and m.dtype == np.int8 or m.dtype.kind == "f" else m.astype(np.float32)

        def hits(q: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Scores and ids of each query's k best; -inf where there are fewer."""
            best, ids = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
            floor = np.full(len(q), -np.inf)  # at most the k-th score
            found: list[tuple] = []
            held = 0  # hits in found
            with np.errstate(all="ignore"):
                signed = np.hstack([np.maximum(q, 0), np.minimum(q, 0)])  # by maxima and minima: bounds
                widest, narrow = reach(q), q.astype(np.float32)
                tiny = (q + 64).astype(np.uint8) if eight and widest < np.inf and q.min() >= -64 and q.max() < 64 and q.shape[1] < 2**16 else None

            def may(score: np.ndarray, least: np.ndarray, r: np.ndarray) -> np.ndarray:
                """Whether such scores, of such ids or later ones, can still change the hits of the queries r."""
                return (score > floor[r]) | (score == floor[r]) & ((least < ids[r, -1]) | (best[r, -1] < floor[r]))

            def merge() -> None:
                nonlocal held
                r, s, d = (np.concatenate(x) for x in zip(*found))
                found.clear()
                held = 0
                u = np.unique(r)
                r, s, d = np.concatenate([np.repeat(u, k), r]), np.concatenate([best[u].ravel(), s]), np.concatenate([ids[u].ravel(), d])
                o = np.lexsort((d, -s, r))
                first = np.searchsorted(r[o], u)
                o = o[first[:, None] + np.arange(k)]
                best[u], ids[u] = s[o], d[o]
                floor[u] = np.maximum(floor[u], best[u, -1])

            def product(r: np.ndarray, m: np.ndarray, kind: type) -> np.ndarray:
                if m.dtype == np.int8:
                    return eight(tiny[r], m)
                shape = len(r), m.shape[1]
                return np.matmul((narrow if kind is np.float32 else q)[r], m, out=space[kind][: shape[0] * shape[1]].reshape(shape))

            def score(tier: int, live: np.ndarray) -> None:
                nonlocal held
                tier_ids, least, hi, lo, m = load(tier)
                kind = np.float32 if widest * top["reach"][tier] < 2.0**24 else np.float64
                m = m if m.dtype == np.int8 and tiny is not None else m.astype(kind, copy=False)
                extremes = np.hstack([hi, lo]).T
                for start in range(0, len(live), query_rows):
                    chunk = live[start : start + query_rows]
                    b = signed[chunk] @ extremes
                    asked = may(b, least[None, :], chunk[:, None])
                    wide = asked.all()  # else a product for each block and the queries that ask for it
                    if wide:
                        every = product(chunk, m, kind)
                        highest = np.maximum.reduceat(every, np.arange(0, len(tier_ids), block_rows), axis=1)
                    for j in range(b.shape[1]):
                        i, e = j * block_rows, min((j + 1) * block_rows, len(tier_ids))
                        r = chunk if wide else chunk[may(b[:, j], least[j], chunk)]
                        if not len(r):
                            continue
                        s = every[:, i:e] if wide else product(r, m[:, i:e], kind)
                        fresh = np.flatnonzero(np.isinf(floor[r]))
                        if len(fresh) and e - i >= k:  # the k-th score of the first block is a floor
                            f = np.where(own[r[fresh]][:, None] == tier_ids[None, i:e], -np.inf, s[fresh])
                            floor[r[fresh]] = np.partition(f, e - i - k, axis=1)[:, e - i - k]
                        some = np.flatnonzero((highest[:, j] if wide else s.max(1)) >= floor[r])
                        if not len(some):
                            continue
                        edge = np.maximum(floor[r[some]], -np.inf if s.dtype.kind == "f" else -(2.0**30)).astype(s.dtype)
                        x, y = np.divmod(np.flatnonzero(s[some] >= edge[:, None]), e - i)
                        hit, at, value = r[some[x]], tier_ids[i + y], s[some[x], y].astype(np.float64)
                        new = (own[hit] != at) & may(value, at, hit)
                        if new.any():
                            found.append((hit[new], value[new], at[new]))
                            held += len(found[-1][0])
                        if held > 8 * len(q):
                            merge()

            b = signed @ np.hstack([top_hi, top_lo]).T
            order = np.argsort(-b, axis=1, kind="stable").astype(np.int32)
            every, taken, step = np.arange(len(q))[:, None], 0, 1
            while taken < len(top_hi):
                asked = np.zeros((len(top_hi), len(q)), dtype=bool)
                for start in range(taken, min(taken + step, len(top_hi)), 64):
                    tiers = order[:, start : min(start + 64, taken + step)]
                    asked[tiers, every] = may(b[every, tiers], top_least[tiers], every)
                some = np.flatnonzero(asked.any(1))
                if not len(some):
                    break  # later bounds are no higher
                for t in some.tolist():
                    live = np.flatnonzero(asked[t])
                    live = live[may(b[live, t], top_least[t], live)]
                    if len(live):
                        score(t, live)
                if found:
                    merge()
                taken, step = taken + step, step * ROUNDS
            return best, ids

        for f in runs(frames, max(query_rows, min(group, 8_000_000 // len(top_hi)))):  # a group holds a bound for each query and tier
            own = f["vec_id"].to_numpy(dtype=np.int64)
            best, ids = hits(np.array(f["v"].tolist(), dtype=np.float64), own)
            r, c = np.nonzero(np.isfinite(best))
            yield pd.DataFrame({"query_id": own[r], "rank": (c + 1).astype(np.int32), "vec_id": ids[r, c], "score": best[r, c].astype(np.int64)})

    return queries.mapInPandas(run, HITS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("embedding", lambda x: F.floor(F.lit(64.0) * x.cast("double")).cast("double"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table(spark, sf_dir, "embeddings").where(F.coalesce(sound, F.lit(False)))
    return search(rows.select("vec_id", v.alias("v")), F.col("vec_id") % 20 == 0)
