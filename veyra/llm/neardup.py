"""MinHash near-dedup with an LSH forest.

Documents of equal shingle sets are one node. Each tree of the forest is a sorted order of the nodes by its own run of
signature values; a node's candidates are its neighbours in that order whose common prefix has LEAST_DEPTH values, and
two more for the second neighbour. Candidates whose signatures agree enough are confirmed on the full sets: first each
node's best one, then all that still join different components. Orders are range partitioned, so no group of copies
lands in one task.

Neighbours alone miss a node whose only partner stands far inside a region of near copies. A last step takes each region
(rows of a tree that share its first LEAST_DEPTH values) that holds several components. Those of up to SMALL rows give
all pairs of different components; in larger ones the nodes outside the largest component meet all the region's nodes in
blocks of bounded size, where full sets are compared at once and only links leave a task. A pair at a similarity of 0.75
is missed only if it shares LEAST_DEPTH values in none of the trees: two in a million.

Null and empty texts have no shingles, are linked with nothing and stay. Rows of equal id share a component, each with its
own text; rows without id are linked with nothing and carry a null component; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, text_batches

SIZE, SHARE, HASHES, TREES, DEPTH, LEAST_DEPTH, NEAR = 5, 75, 128, 24, 12, 3, 2
#: Regions of more rows are compared in blocks of BLOCK by BLOCK shingles, or one node where that has more.
SMALL, BLOCK = 48, 200_000
#: Least share of agreeing signature values; at 128 values a pair at 0.75 falls below it once in more than ten million.
SKETCHED = 0.54
M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: ASCII letters in lower case; the separators are a space, tabs and line ends (9 to 13).
LOWER = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of size words, or of all words if they are fewer."""
    data = np.frombuffer((text or "").encode().translate(LOWER), dtype=np.uint8)
    inside = np.concatenate(([0], (data != 32).astype(np.int8), [0]))
    edge = np.flatnonzero(np.diff(inside))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        n = len(data)
        # a word's hash: the sum of its bytes' mixed values by place within the word
        place = np.arange(n) - np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [n]))))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(data.astype(np.uint64) * M + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)))))
        words = _mix(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64) * M)
        k = min(size, len(words))
        out = np.zeros(len(words) - k + 1, np.uint64)
        for i in range(k):
            out = _mix(out + words[i : len(words) - k + 1 + i] + M)
    return np.unique(out)


_R = np.random.default_rng(20240611)
A, B = _R.integers(1, 1 << 62, (HASHES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1), _R.integers(0, 1 << 63, (HASHES, 1), dtype=np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """HASHES values of 16 bits, each a part of the least value of one hash function over the set."""
    with np.errstate(over="ignore"):
        least = np.minimum.reduce([(s[i : i + 512] * A + B).min(axis=1) for i in range(0, len(s), 512)])
        return (_mix(least) >> np.uint64(48)).astype(np.uint16)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part, out = batch.slice(at, 256), []
            for text in part.column(1).to_pylist():
                s = shingles(text)
                with np.errstate(over="ignore"):
                    key = [int(_mix(s).sum().view(np.int64)), int(_mix(s + M).sum().view(np.int64))] if len(s) else [0, 0]
                out.append((len(s), *key, signature(s).tobytes() if len(s) else None))
            n, k1, k2, sig = zip(*out)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "t", "n", "k1", "k2", "sig"])


def _neighbours(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node) in order; key: the tree and its values. Pairs of near rows with a long common prefix."""
    before: list[tuple[bytes, int]] = []
    for batch in frames:
        keys, nodes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        a, b = [], []
        for key, node in zip(keys, nodes):
            for back, (other, x) in enumerate(reversed(before)):
                same = 0
                while same < DEPTH and key[: 3 + 2 * same] == other[: 3 + 2 * same]:
                    same += 1
                if key[0] == other[0] and same >= LEAST_DEPTH + (back > 0) * 2:
                    a.append(min(x, node))
                    b.append(max(x, node))
            before = [*before[-(NEAR - 1) :], (key, node)]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    orders = [np.random.default_rng(t).permutation(HASHES)[: DEPTH - 1] for t in range(TREES)]
    for batch in batches:
        keys, nodes = [], []
        for node, sig in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            values = np.frombuffer(sig, np.uint16)
            for t, order in enumerate(orders):
                keys.append(bytes([t]) + values[order].astype(">u2").tobytes())
                nodes.append(node)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(nodes, pa.int64())], names=["key", "node"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, x, y) whose signatures agree enough, with the share that agrees."""
    for batch in batches:
        share = [float((np.frombuffer(p, np.uint16) == np.frombuffer(q, np.uint16)).mean()) for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share, pa.float64())], names=["a", "b", "alike"])
        yield out.filter(pa.array([x >= SKETCHED for x in share], pa.bool_()))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, p, q) whose texts' sets are alike."""
    kept = lru_cache(64)(shingles)  # successive pairs share a text

    def one(p: str, q: str) -> bool:
        s, t = kept(p), kept(q)
        both = len(np.intersect1d(s, t, assume_unique=True))
        return 100 * both >= SHARE * (len(s) + len(t) - both)

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            good = [one(p, q) for p, q in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def _buckets(sig: str = "sig"):
    """Of each tree, a hash of the tree and its first LEAST_DEPTH values."""
    starts = [np.random.default_rng(t).permutation(HASHES)[:LEAST_DEPTH] for t in range(TREES)]
    return F.array(*[F.xxhash64(F.lit(t), *[F.substring(sig, int(2 * i + 1), 2) for i in start]) for t, start in enumerate(starts)])


def regions(sigs: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, node, root, n, main, size, total, outside) of rows of each tree that share its first LEAST_DEPTH values with
    a node of another component; main is the bucket's most frequent component, size its number of rows, total that of
    their shingles, outside that of shingles in other components."""
    rooted = sigs.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "n", F.explode(_buckets()).alias("bucket"))
    held = rooted.groupBy("bucket", "root").agg(F.count("*").alias("c"), F.sum("n").alias("n")).groupBy("bucket").agg(F.max(F.struct("c", "root", "n")).alias("top"), F.count("*").alias("kinds"), F.sum("c").alias("size"), F.sum("n").alias("total")).where("kinds > 1")
    held = held.select("bucket", F.col("top.root").alias("main"), "size", "total", (F.col("total") - F.col("top.n")).alias("outside"))
    return materialize(rooted.join(held, "bucket"), "mixed")


def small_regions(mixed: DataFrame) -> DataFrame:
    """All pairs (a, b) of different components in regions of at most SMALL rows."""
    small = mixed.where(F.col("size") <= SMALL)
    x = small.where("root <> main").select("bucket", F.col("node").alias("x"), F.col("root").alias("rx"))
    y = small.select("bucket", F.col("node").alias("y"), F.col("root").alias("ry"), (F.col("root") == F.col("main")).alias("inside"))
    met = x.join(y, "bucket").where((F.col("rx") != F.col("ry")) & (F.col("inside") | (F.col("x") < F.col("y"))))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _block_links(key: tuple, table: pa.Table) -> pa.Table:
    """Links of a block: rows x against rows y (side 0 and 1), counted through the places of each shingle among the y."""
    side, node, root = (table.column(c).to_numpy() for c in ("side", "node", "root"))
    sets = [np.frombuffer(v, np.uint64) for v in table.column("shingles").to_pylist()]
    ys = np.flatnonzero(side == 1)
    a, b = [], []
    if len(ys):
        sizes = np.array([len(sets[i]) for i in ys])
        every, of = np.concatenate([sets[i] for i in ys]), np.repeat(np.arange(len(ys)), sizes)
        order = np.argsort(every, kind="stable")
        every, of = every[order], of[order]
        for i in np.flatnonzero(side == 0):
            lo, hi = np.searchsorted(every, sets[i], "left"), np.searchsorted(every, sets[i], "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            both = np.bincount(of[at], minlength=len(ys))
            hit = np.flatnonzero((100 * both >= SHARE * (sizes + len(sets[i]) - both)) & (root[ys] != root[i]))
            _, one = np.unique(root[ys][hit], return_index=True)  # one link to each component is enough
            a += [min(int(node[i]), int(node[ys[j]])) for j in hit[one]]
            b += [max(int(node[i]), int(node[ys[j]])) for j in hit[one]]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["node", "shingles"])


def large_regions(mixed: DataFrame, texts_of) -> DataFrame:
    """Links (a, b) between components in larger regions. Nodes outside the main component meet all the region's nodes in
    blocks of about BLOCK by BLOCK shingles, where full sets are compared at once; pairs themselves are never rows."""
    large = mixed.where(F.col("size") > SMALL)
    sets = texts_of(large.select("node")).mapInArrow(_sets, "node long, shingles binary")

    def cut(n: str):
        return F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK)).cast("int")

    def dealt(salt: int, n: str):
        return F.pmod(F.xxhash64(F.lit(salt), "node"), cut(n)).cast("int")

    x = large.where("root <> main").select("bucket", "node", "root", F.lit(0).alias("side"), dealt(1, "outside").alias("i"), F.explode(F.sequence(F.lit(0), cut("total") - 1)).alias("j"))
    y = large.select("bucket", "node", "root", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), cut("outside") - 1)).alias("i"), dealt(2, "total").alias("j"))
    met = x.unionByName(y).join(sets, "node")
    return met.groupBy("bucket", "i", "j").applyInArrow(_block_links, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root (least node that links reach) of links (a, b): alternating large and small stars. A hot centre's
    row is one pair for each neighbour, and minima are summed before the shuffle."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, seen = materialize(edges, "edges"), None
    count = edges.count()
    while True:  # ends when a round changes nothing
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = materialize(small, "edges", count)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen, count = now, now[0]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs."""
    text_batches(docs.sparkSession)
    ident = [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("t")]
    sketched = materialize(docs.select(ident[0], text_col, ident[1]).mapInArrow(_sketch, "doc_id long, t long, n long, k1 long, k2 long, sig binary"), "sketches")
    sets = sketched.where("n > 0 and doc_id is not null")
    key = ["k1", "k2", "n"]
    nodes = sets.groupBy(*key).agg(F.min(F.struct("doc_id", "t")).alias("head"))
    # a node is its set's least doc_id; where rows of one id have several sets, the others take numbers of their own beyond all ids
    first = nodes.groupBy("head.doc_id").agg(F.min("head.t").alias("own"))
    nodes = nodes.select(*key, "head", F.col("head.doc_id").alias("doc_id")).join(first, "doc_id")
    nodes = nodes.select(*key, "head", F.when(F.col("head.t") == F.col("own"), F.col("doc_id")).otherwise(F.shiftrightunsigned("k1", 2) + F.lit(1 << 62)).alias("node"))
    member = materialize(sets.join(nodes, key).select("doc_id", "node", F.when(F.struct("doc_id", "t") == F.col("head"), F.struct("t", "sig", "n")).alias("at")), "members")
    heads = materialize(member.where("at is not null").select("node", "doc_id", "at.t", "at.sig", "at.n").dropDuplicates(["node"]), "signatures")
    member, sigs = member.select("doc_id", "node"), heads.select("node", "sig", "n")
    rows = sigs.select("node", "sig").mapInArrow(_forest, "key binary, node long").repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    pairs = rows.mapInArrow(_neighbours, "a long, b long").distinct()
    x, y = sigs.select(F.col("node").alias("a"), F.col("sig").alias("x")), sigs.select(F.col("node").alias("b"), F.col("sig").alias("y"))

    def agreeing(some: DataFrame) -> DataFrame:
        return some.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_alike, "a long, b long, alike double")

    def texts_of(some: DataFrame) -> DataFrame:
        needed = (some.select(F.explode(F.array("a", "b")).alias("node")) if "a" in some.columns else some).distinct()
        needed = heads.join(needed, "node").select("node", "doc_id", "t")
        texts = docs.select(*ident, F.col(text_col).alias("text")).where(F.length("text") > 0)
        return materialize(texts.join(needed.hint("merge"), ["doc_id", "t"]).select("node", "text").dropDuplicates(["node"]), "texts")  # only documents with candidates; dealt out alike at every size

    pairs = materialize(agreeing(pairs), "pairs")
    texts = texts_of(pairs)
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("alike", "a")).alias("a")).select("a", "b")

    def confirmed(some: DataFrame, texts: DataFrame = texts) -> DataFrame:
        p, q = texts.select(F.col("node").alias("a"), F.col("text").alias("p")), texts.select(F.col("node").alias("b"), F.col("text").alias("q"))
        return some.join(p, "a").join(q, "b").select("a", "b", "p", "q").mapInArrow(_linked, "a long, b long")

    links = materialize(confirmed(best), "links")
    roots = components(links)

    def across(some: DataFrame) -> DataFrame:
        ra, rb = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        return some.join(ra, "a", "left").join(rb, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")

    more = confirmed(across(pairs.select("a", "b")))
    spread = sets.select("doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id")  # rows of one id
    same_id = member.join(spread, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b")
    links = materialize(links.unionByName(more).unionByName(same_id), "links")
    roots = components(links)
    mixed = regions(sigs, roots)
    rest = materialize(agreeing(small_regions(mixed)), "pairs")
    roots = components(links.unionByName(confirmed(rest, texts_of(rest))).unionByName(large_regions(mixed, texts_of)))
    placed = member.distinct().join(roots, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "node")).alias("component_id"))
    return sketched.select("doc_id", F.col("n").alias("n_shingles")).join(placed, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster(table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
