"""Nearest rows of a bounded set of queries, and feature weights that follow from them.

Queries are broadcast (their number is a parameter); every task keeps the k nearest of its own rows for each query and
class, and sorts a query's rows again only where a nearer one comes, so what is shuffled is k rows for each query, class and task. Ties go to the smaller key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import dealt

#: How many differences a task holds at once, and the key of no row.
BLOCK, NONE = 1 << 21, np.iinfo(np.int64).max


def nearest(rows: DataFrame, queries: DataFrame, features: Sequence[str], key: str, k: int, *, metric: str = "l2", label: str | None = None, max_queries: int = 10_000) -> DataFrame:
    """(query, key, label, distance, rank): the k nearest other rows of each query, of each class where label is given."""
    if metric not in ("l1", "l2"):
        raise ValueError(f"unknown metric {metric!r}")
    asked = queries.select(key, *features).limit(max_queries + 1).collect()
    if len(asked) > max_queries:
        raise ValueError(f"more than {max_queries} queries")
    keys = np.array([r[0] for r in asked], dtype=np.int64)
    at = np.array([[float(x or 0.0) for x in r[1:]] for r in asked], dtype=float).reshape(len(asked), len(features))
    sent = rows.sparkSession.sparkContext.broadcast((keys, at))
    of = [F.col(label).cast("long").alias("label")] if label else [F.lit(0).cast("long").alias("label")]

    block = max(1, BLOCK // (2048 * max(1, len(features))))

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, at = sent.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of each label: distances and keys, queries by k, in order
        for f in frames:
            for start in range(0, len(f), 2048):
                part = f.iloc[start : start + 2048]
                x = np.nan_to_num(part[list(features)].to_numpy(dtype=float))
                own, of = part[key].to_numpy(dtype=np.int64), part["label"].to_numpy()
                for first in range(0, len(at), block):
                    gap = np.abs(x[None, :, :] - at[first : first + block, None, :])
                    d = np.round(gap.sum(2) if metric == "l1" else np.sqrt((gap * gap).sum(2)), 9)
                    for label in pd.unique(of[pd.notna(of)]):
                        if label not in best:
                            best[label] = np.full((len(at), k), np.inf), np.full((len(at), k), NONE)
                        dist, kept = (b[first : first + block] for b in best[label])
                        mine = np.flatnonzero(of == label)
                        e, o = d[:, mine], own[mine]
                        better = ((e < dist[:, -1:]) | (e == dist[:, -1:]) & (o < kept[:, -1:])) & (o != keys[first : first + block, None])
                        for i in np.flatnonzero(better.any(axis=1)):
                            both, names = np.concatenate([dist[i], e[i, better[i]]]), np.concatenate([kept[i], o[better[i]]])
                            order = np.lexsort((names, both))[:k]
                            dist[i], kept[i] = both[order], names[order]
        for label, (dist, kept) in best.items():
            i, j = np.nonzero(kept != NONE)
            yield pd.DataFrame({"query": keys[i], "key": kept[i, j], "label": np.full(len(i), int(label)), "distance": dist[i, j]})

    found = rows.select(F.col(key).cast("long").alias(key), *of, *[F.col(f"`{f}`").cast("double").alias(f) for f in features]).mapInPandas(near, "query long, key long, label long, distance double")
    order = Window.partitionBy("query", "label").orderBy("distance", "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def relief_f(df: DataFrame, features: Sequence[str], label: str, key: str, *, k: int = 10, samples: int = 500, seed: int = 0) -> DataFrame:
    """(feature, score): mean difference to the k nearest rows of other classes, weighted by their priors, less that to the
    row's own class, over a sample of rows (all, if there are no more). Values are scaled by their range; NULL is 0."""
    known = df.where(F.col(label).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(label).cast("long").alias(label), *[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)).alias(f) for f in features])
    span = known.agg(*[(F.max(f"`{f}`") - F.min(f"`{f}`")).alias(f"s{i}") for i, f in enumerate(features)]).first()
    scaled = known.select(key, label, *[(F.col(f"`{f}`") / (span[i] or 1.0)).alias(f) for i, f in enumerate(features)])
    sample = dealt(scaled, [], F.col(key), seed, "_i").where(F.col("_i") < samples).drop("_i")
    found = nearest(scaled, sample, features, key, k, metric="l1", label=label, max_queries=samples)
    values = F.array(*[F.col(f"`{f}`") for f in features])
    q = sample.select(F.col(key).alias("query"), F.col(label).alias("own"), values.alias("x"))
    priors = known.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("c"))
    priors = priors.crossJoin(F.broadcast(priors.agg(F.sum("c").alias("all")))).select("label", (F.col("c") / F.col("all")).alias("prior"))
    mine = priors.withColumnsRenamed({"label": "own", "prior": "own_prior"})
    pairs = found.join(F.broadcast(q), "query").join(scaled.select(F.col(key).alias("key"), values.alias("z")), "key")
    gaps = pairs.select("query", "own", "label", F.posexplode(F.zip_with("x", "z", lambda a, b: F.abs(a - b))).alias("f", "gap"))
    each = gaps.groupBy("query", "own", "label", "f").agg(F.avg("gap").alias("gap")).join(F.broadcast(priors), "label").join(F.broadcast(mine), "own")
    weight = F.when(F.col("own") == F.col("label"), -1.0).otherwise(F.col("prior") / (1 - F.col("own_prior") + 1e-12))
    total = sample.count() or 1
    names = F.array(*map(F.lit, features))
    return each.groupBy("f").agg((F.sum(weight * F.col("gap")) / total).alias("score")).select(names[F.col("f")].alias("feature"), "score")
