"""Resharding by minimum-cost flow: rows form blocks within their old shards, a flow from old sizes to new capacities
says how many bytes go where, and whole blocks realise it. Law: bytes (shard sizes as near as whole blocks allow).

The driver sees only block sizes, n_old * per_shard of them whatever the table's size. Blocks are dealt by hashes of id
and text, so rows of one id, or without id, spread unless their texts are equal too. Null texts have no bytes. Columns
named size, old_shard, block, shard or slot are replaced, all others stay; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, shared_dir, table


def min_cost_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """Successive shortest paths on the transport graph; supply and demand have equal sums. cost(i, j) is for each byte."""
    n, m = len(supply), len(demand)
    left, need, flow = list(supply), list(demand), defaultdict(int)
    while any(left):
        dist, back = {("s", i): 0 for i in range(n) if left[i]}, {}
        changed = True
        while changed:  # Bellman-Ford, as residual arcs have negative costs
            changed = False
            for i in range(n):
                for j in range(m):
                    a, b, c = ("s", i), ("t", j), cost(i, j)
                    if a in dist and dist[a] + c < dist.get(b, 1 << 60):
                        dist[b], back[b], changed = dist[a] + c, a, True
                    if flow[i, j] and b in dist and dist[b] - c < dist.get(a, 1 << 60):
                        dist[a], back[a], changed = dist[b] - c, b, True
        at = min((j for j in range(m) if need[j] and ("t", j) in dist), key=lambda j: dist["t", j])
        path, x = [("t", at)], ("t", at)
        while x in back:
            path.append(x := back[x])
        amount = min([need[at], left[x[1]]] + [flow[a[1], b[1]] for a, b in zip(path, path[1:]) if a[0] == "s"])
        for b, a in zip(path, path[1:]):
            if a[0] == "s":
                flow[a[1], b[1]] += amount
            else:
                flow[b[1], a[1]] -= amount
        left[x[1]] -= amount
        need[at] -= amount
    return {k: v for k, v in flow.items() if v}


def plan(sizes: dict[tuple[int, int], int], n_old: int, n_new: int) -> dict[tuple[int, int], int]:
    """The new shard of each block (old shard, number): the flow's transfers by whole blocks, then repairs while they help."""
    total = sum(sizes.values())
    caps = [total // n_new + (j < total % n_new) for j in range(n_new)]
    supply = [0] * n_old
    for (i, _), v in sizes.items():
        supply[i] += v
    flow = min_cost_flow(supply, caps, lambda i, j: int(i != j))
    target, load = {}, [0] * n_new
    for i in range(n_old):
        rest = {j: flow.get((i, j), 0) for j in range(n_new) if flow.get((i, j), 0) or i == j}
        for v, b in sorted(((v, b) for (o, b), v in sizes.items() if o == i), reverse=True):
            j = max(rest, key=lambda j: (rest[j], j == i))
            rest[j] -= v
            load[j] += v
            target[i, b] = j
    held = defaultdict(list)
    for k, j in target.items():
        held[j].append((sizes[k], k))
    for x in held.values():
        x.sort()
    order = [(v, j) for j, v in enumerate(load)]
    heapq.heapify(order)
    while True:  # each move lowers the sum of squares; from the fullest to the emptiest shard, the block nearest to half of the gap
        lo, hi = min(range(n_new), key=load.__getitem__), max(range(n_new), key=load.__getitem__)
        gap = load[hi] - load[lo]
        fits = [x for x in held[hi] if 0 < x[0] < gap]
        if not fits:
            break
        v, k = min(fits, key=lambda x: (abs(2 * x[0] - gap), x))
        held[hi].remove((v, k))
        held[lo].append((v, k))
        target[k] = lo
        load[hi] -= v
        load[lo] += v
    return target


ADDED = ("size", "old_shard", "block", "shard", "slot")


def reshard(docs: DataFrame, old_shard: Column, n_old: int, n_new: int, *, per_shard: int = 256, rows_per_slice: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with size, old_shard, block, shard and slot (gapless from 0 in each shard)."""
    rows = docs.withColumn("_old", old_shard.cast("int"))
    rows = rows.drop(*[c for c in ADDED if c not in (id_col, text_col)]).withColumnRenamed("_old", "old_shard")
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long") + 8
    slices = max(1, -(-docs.count() // (n_old * per_shard * rows_per_slice)))
    spread = F.xxhash64(id_col, F.crc32(F.coalesce(F.col(text_col), F.lit(""))))
    rows = rows.withColumns({"size": size, "block": F.pmod(spread, F.lit(per_shard)).cast("int"), "_slice": F.pmod(F.shiftright(spread, 20), F.lit(slices)).cast("int"), "_spread": spread})
    counts = materialize(rows.groupBy("old_shard", "block", "_slice").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "blocks")
    sizes = {(r[0], r[1]): r[2] for r in counts.groupBy("old_shard", "block").agg(F.sum("bytes")).collect()}  # n_old * per_shard rows at most
    target = plan(sizes, n_old, n_new) if sizes else {}
    moves = docs.sparkSession.createDataFrame([(o, b, j) for (o, b), j in target.items()], "old_shard int, block int, shard int")
    order = Window.partitionBy("shard").orderBy("old_shard", "block", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.join(F.broadcast(moves), ["old_shard", "block"]).withColumn("_start", F.coalesce(F.sum("n").over(order), F.lit(0))).select("old_shard", "block", "_slice", "shard", "_start")
    keys = ["old_shard", "block", "_slice"]
    within = F.row_number().over(Window.partitionBy(*keys).orderBy("_spread", id_col, "size")) - 1
    return rows.withColumn("_within", within).join(starts, keys).withColumn("slot", F.col("_start") + F.col("_within")).drop("_slice", "_within", "_start", "_spread")


def rewrite(placed: DataFrame, path: str) -> None:
    """Brings the layout below path (a folder for each shard) to the placement: writes the shards that gained or lost
    blocks and those that path doesn't hold yet, as a whole, each in place of its old folder when the job commits. Other
    shards keep their files. A shard that lost all its rows loses its folder."""
    spark = placed.sparkSession
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = {int(f.getPath().getName().partition("=")[2]) for f in (fs.listStatus(root) if fs.exists(root) else []) if f.getPath().getName().startswith("shard=")}
    held = placed.groupBy("shard").agg(F.max((F.col("old_shard") != F.col("shard")).cast("int")).alias("gained")).collect()  # a row for each shard
    lost = {r[0] for r in placed.where("old_shard <> shard").select("old_shard").distinct().collect()}
    full = {r["shard"] for r in held}
    touched = sorted({r["shard"] for r in held if r["gained"]} | full & lost | full - there)
    rows = placed.where(F.col("shard").isin(touched)) if touched else placed.limit(0)
    rows.sortWithinPartitions("shard", "slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    for gone in (lost & there) - full:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, f"shard={gone}"), True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    old = F.pmod(F.crc32(F.coalesce("source", F.lit(""))) + F.coalesce("doc_id", F.lit(0)), F.lit(16))
    placed = reshard(docs, old, 16, 24)
    path = shared_dir(spark, "shards")
    rewrite(placed, path)
    back = spark.read.schema(placed.schema).parquet(path)
    out = back.withColumns({"text_crc32": F.crc32(F.coalesce("text", F.lit(""))), "law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
