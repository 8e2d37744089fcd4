"""AUC under many weights of the rows at once: one order of the scores serves all of them.

Rows are sorted by range of score. Each task reads its range in order and keeps one number for each weight, so neither
memory nor what is shuffled grows with rows times weights. A range gives its first score, its last score and what lies
between; equal scores that fell to several ranges meet again when these few rows are put together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of rows times weights that a task holds at once.
CELLS = 1 << 19


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; NULL is a value."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
    return differ.to_numpy(zero_copy_only=False)


class _Range:
    """What a task keeps of the rows of one group, in order of score: below and above are sums of negative and positive
    weights so far, u counts pairs in the right order; the score that is being read is held apart, as more of it may come."""

    def __init__(self, group: list[pa.Array], k: int):
        self.group, self.cells = group, []
        self.u, self.above, self.below = np.zeros(k), np.zeros(k), np.zeros(k)
        self.first = self.open = self.lo = self.hi = None

    def add(self, scores: list, p: np.ndarray, n: np.ndarray) -> None:
        if self.open is not None and self.open[0] == scores[0]:
            p[:, 0] += self.open[1]
            n[:, 0] += self.open[2]
        elif self.open is not None:
            scores, p, n = [self.open[0], *scores], np.column_stack([self.open[1], p]), np.column_stack([self.open[2], n])
        self.open = scores[-1], p[:, -1].copy(), n[:, -1].copy()
        if len(scores) > 1 and self.first is None:
            self.first = scores[0], p[:, 0].copy(), n[:, 0].copy()
            scores, p, n = scores[1:], p[:, 1:], n[:, 1:]
        if len(scores) > 1:
            p, n = p[:, :-1], n[:, :-1]
            upto = np.cumsum(n, axis=1)
            self.u += np.einsum("ij,ij->i", p, self.below[:, None] + upto - n / 2)
            self.above += p.sum(axis=1)
            self.below += upto[:, -1]
            self.lo, self.hi = scores[0] if self.lo is None else self.lo, scores[-2]

    def rows(self) -> Iterator[tuple]:
        """(lo, hi, above, below, u) of the first score, what lies between, and the last score."""
        for s, p, n in [x for x in (self.first, self.open) if x is not None]:
            yield s, s, p, n, p * n / 2
        if self.lo is not None:
            yield self.lo, self.hi, self.above, self.below, self.u


def _together(parts: pd.DataFrame) -> list[float | None]:
    """AUC of each weight from all ranges of a group; NULL where a class has no weight."""
    u = above = below = 0.0
    for (lo, hi), same in parts.groupby(["lo", "hi"], sort=True):
        p, n = np.sum(same["above"].tolist(), axis=0), np.sum(same["below"].tolist(), axis=0)
        u = u + (p * n / 2 if lo == hi else np.asarray(same["u"].iloc[0])) + p * below
        above, below = above + p, below + n
    with np.errstate(all="ignore"):
        got = u / (above * below)
    return [float(x) if np.isfinite(x) else None for x in got]


def replicated_auc(df: DataFrame, by: Sequence[str], score: str, p: Column, n: Column, inputs: Sequence[Column], weigh: Callable[[list[np.ndarray]], np.ndarray], k: int) -> DataFrame:
    """(by, t): the tie-aware AUC of each group under each of k weights, an array; NULL where a class has no weight.

    p and n are what a row counts as a positive and as a negative. inputs are made after rows are sorted, so that only what
    they read is shuffled; weigh makes the weights, k by rows, of their values."""
    salt = F.xxhash64(*[f"`{c}`" for c, t in df.dtypes if "map<" not in t and t != "variant"])
    placed = df.withColumn("_salt", salt).repartitionByRange(*by, score, "_salt").sortWithinPartitions(*by, score)
    m = len(by)
    named = [F.col(c).alias(f"_b{i}") for i, c in enumerate(by)]
    rows = placed.select(*named, F.col(score).alias("_s"), p.cast("double").alias("_p"), n.cast("double").alias("_n"), *[x.alias(f"_i{i}") for i, x in enumerate(inputs)])
    fields = {f.name: f for f in rows.schema.fields}
    of = ", ".join([f"_b{i} {fields[f'_b{i}'].dataType.simpleString()}" for i in range(m)] + [f"{x} {fields['_s'].dataType.simpleString()}" for x in ("lo", "hi")])
    step = max(16, CELLS // k)

    def out(r: _Range, kind: pa.DataType) -> pa.RecordBatch:
        got = list(r.rows())
        groups = [pa.concat_arrays([g] * len(got)) for g in r.group]
        ends = [pa.array([x[i] for x in got], kind) for i in (0, 1)]
        sums = [pa.array([x[i].tolist() for x in got], pa.list_(pa.float64())) for i in (2, 3, 4)]
        return pa.RecordBatch.from_arrays([*groups, *ends, *sums], names=[*[f"_b{i}" for i in range(m)], "lo", "hi", "above", "below", "u"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind = None, None
        for whole in batches:
            kind = whole.column(m).type
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                size = batch.num_rows
                new, tied = np.zeros(size, bool), np.ones(size, bool)
                for i in range(m):
                    new[1:] |= _changes(batch.column(i))
                tied[1:] = new[1:] | _changes(batch.column(m))
                new[0] = now is None or any(now.group[i][0] != batch.column(i)[0] and not (now.group[i].null_count and batch.column(i).slice(0, 1).null_count) for i in range(m))
                values = [pc.fill_null(c, 0).to_numpy(zero_copy_only=False) for c in batch.columns[m + 1 :]]
                w = weigh(values[2:])
                starts = np.flatnonzero(tied)
                p, n = np.add.reduceat(w * values[0], starts, axis=1), np.add.reduceat(w * values[1], starts, axis=1)
                scores = batch.column(m).take(pa.array(starts)).to_pylist()
                edges = [*np.searchsorted(starts, np.flatnonzero(new)).tolist(), len(starts)]
                if edges[0] > 0:
                    now.add(scores[: edges[0]], p[:, : edges[0]], n[:, : edges[0]])
                for a, b in zip(edges, edges[1:]):
                    if now is not None:
                        yield out(now, kind)
                    now = _Range([batch.column(i).slice(int(starts[a]), 1) for i in range(m)], k)
                    now.add(scores[a:b], p[:, a:b], n[:, a:b])
        if now is not None:
            yield out(now, kind)

    parts = rows.mapInArrow(read, f"{of}, above array<double>, below array<double>, u array<double>")
    kinds = ", ".join([*[f"_b{i} {fields[f'_b{i}'].dataType.simpleString()}" for i in range(m)], "t array<double>"])

    def finish(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{f"_b{i}": f[f"_b{i}"].iloc[:1] for i in range(m)}, "t": pd.Series([_together(f)], index=f.index[:1])})

    got = parts.groupBy(*[f"_b{i}" for i in range(m)]).applyInPandas(finish, kinds)
    return got.select(*[F.col(f"_b{i}").alias(c) for i, c in enumerate(by)], "t")
