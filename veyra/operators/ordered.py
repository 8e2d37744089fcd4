"""Orders over whole tables without a task that holds a whole group.

A sorted scan is cut at approximate quantiles of the key: each piece is a window of its own, sums of the pieces before
it are added from a table with one row for each piece. Where a row falls depends on its key and the cuts only, so a
recomputed task agrees with the others. Keys are numbers; NULL groups are groups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECES = 64
#: Groups of more rows than this are cut into pieces.
LARGE = 50_000


def join_on(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join in which NULL keys meet; without keys, b is one row."""
    if not keys:
        return a.crossJoin(F.broadcast(b))
    other = b.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    met = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return a.join(other, met, how).drop(*[f"_r_{k}" for k in keys])


def cut(df: DataFrame, by: Sequence[str], key: str, pieces: int = PIECES, totals: Mapping[str, str] | None = None, name: str = "_piece") -> DataFrame:
    """Adds name: how many of the group's cuts are at or below the key, and sums over the group, from name to column, by
    totals. Groups of at most LARGE rows are one piece, so the cuts that every task is sent are at most one group's for each
    LARGE rows."""
    totals = totals or {}
    at = ", ".join(str(i / pieces) for i in range(1, pieces))
    cuts = df.groupBy(*by).agg(F.count("*").alias("_size"), F.expr(f"percentile_approx(`{key}`, array({at}), {8 * pieces})").alias("_cuts"), *[F.sum(c).alias(n) for n, c in totals.items()])
    placed = join_on(df, F.broadcast(cuts.where(F.col("_size") > LARGE).drop("_size")), by, "left") if by else df.crossJoin(F.broadcast(cuts.drop("_size")))
    placed = placed.withColumn(name, F.when(F.col("_cuts").isNotNull(), F.size(F.filter(F.array_distinct("_cuts"), lambda c: c <= F.col(key)))).otherwise(0)).drop("_cuts")
    return placed.withColumns({n: F.coalesce(n, F.sum(c).over(Window.partitionBy(*by, name))) for n, c in totals.items()}) if by else placed


def cumulate(df: DataFrame, by: Sequence[str], key: str, sums: Sequence[str], *, ties: Sequence[str] = (), pieces: int = PIECES, piece: Column | None = None) -> DataFrame:
    """Adds below_<c> for each c of sums: its total over the group's rows before this one, in order of key and ties. piece,
    a column that rises with the key, takes the place of cuts at quantiles."""
    known = df.where(F.col(key).isNotNull())
    placed = cut(known, by, key, pieces) if piece is None else known.withColumn("_piece", piece)
    totals = placed.groupBy(*by, "_piece").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    ahead = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_piece", *[F.coalesce(F.sum(f"_t_{c}").over(ahead), F.lit(0)).alias(f"_o_{c}") for c in sums])
    if piece is None or not by:
        offsets = F.broadcast(offsets if piece is not None else offsets.where("_piece > 0"))  # few: only large groups have several pieces
    within = Window.partitionBy(*by, "_piece").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    out = join_on(placed, offsets, [*by, "_piece"], "left").withColumns({f"below_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) + F.coalesce(F.col(f"_o_{c}"), F.lit(0)) for c in sums})
    return out.drop("_piece", *[f"_o_{c}" for c in sums])


def running(df: DataFrame, by: Sequence[str], key: str, highest: Mapping[str, Column], lowest: Mapping[str, Column], piece: Column) -> DataFrame:
    """Adds for each name of highest the largest value of the group's rows up to this one in order of key, and for each of
    lowest the least value from this row on. Keys are distinct within a group; NULL values are passed over. piece is that of cut()."""
    placed = df.withColumns({**highest, **lowest, "_piece": piece})
    ends = placed.groupBy(*by, "_piece").agg(*[F.max(c).alias(f"_t_{c}") for c in highest], *[F.min(c).alias(f"_t_{c}") for c in lowest])
    order = Window.partitionBy(*by)
    up, down = (order.orderBy(o("_piece")).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc, F.desc))
    beyond = ends.select(*by, "_piece", *[F.max(f"_t_{c}").over(up).alias(f"_o_{c}") for c in highest], *[F.min(f"_t_{c}").over(down).alias(f"_o_{c}") for c in lowest])
    beyond = beyond.where(reduce(lambda x, y: x | y, [F.col(f"_o_{c}").isNotNull() for c in [*highest, *lowest]]))  # of groups of several pieces
    within = Window.partitionBy(*by, "_piece")
    up, down = (within.orderBy(o(key)).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc, F.desc))
    out = join_on(placed, F.broadcast(beyond), [*by, "_piece"], "left")
    out = out.withColumns({c: F.greatest(F.max(c).over(up), F.col(f"_o_{c}")) for c in highest} | {c: F.least(F.min(c).over(down), F.col(f"_o_{c}")) for c in lowest})
    return out.drop("_piece", *[f"_o_{c}" for c in [*highest, *lowest]])


def numbered(df: DataFrame, by: Sequence[str], key: str, name: str, ties: Sequence[str] = (), piece: Column | None = None) -> DataFrame:
    """Adds the row's number within its group, from 0, in order of key and ties (which must tell rows apart)."""
    return cumulate(df.withColumn("_one", F.lit(1).cast("long")), by, key, ["_one"], ties=ties, piece=piece).withColumnRenamed("below__one", name).drop("_one")


def counted(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """(by, x, n, below_n): distinct values with their counts and the rows before them."""
    return cumulate(df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("n")), by, x, ["n"])


def average_ranks(df: DataFrame, by: Sequence[str], x: str, name: str) -> DataFrame:
    """Adds the rank of x in its group, ties sharing their mean; rows without x go."""
    ranks = counted(df, by, x).select(*by, x, (F.col("below_n") + (F.col("n") + 1) / 2).alias(name))
    return join_on(df.where(F.col(x).isNotNull()), ranks, [*by, x])


def quantiles(cells: DataFrame, by: Sequence[str], x: str, points: Sequence[float]) -> DataFrame:
    """(by, cuts): exact quantiles with linear interpolation, from cells of counted(); what is gathered is one row a task and group.
    The number of rows of each group is sent to every task: groups are few, as features of a table are."""
    total = join_on(cells, F.broadcast(cells.groupBy(*by).agg(F.sum("n").alias("_all"))), by)
    upto = F.col("below_n") + F.col("n")

    def at(where: Column) -> Column:
        return F.min(F.when(upto > where, F.col(x)))

    places = [F.lit(p) * (F.col("_all") - 1) for p in points]
    got = total.groupBy(*by).agg(F.max("_all").alias("_all"), *[f for i, w in enumerate(places) for f in (at(F.floor(w)).alias(f"_l{i}"), at(F.ceil(w)).alias(f"_h{i}"))])
    cuts = [F.col(f"_l{i}") + (w - F.floor(w)) * (F.col(f"_h{i}") - F.col(f"_l{i}")) for i, w in enumerate(places)]
    return got.select(*by, F.array(*cuts).alias("cuts"))


def mixed(seed: int, *key: Column) -> Column:
    """A number that looks random, from a seed and what tells rows apart: 60 bits of MD5, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key])), 1, 15), 16, 10).cast("long")


def dealt(df: DataFrame, by: Sequence[str], key: Column, seed: int, name: str) -> DataFrame:
    """Adds the row's number, from 0, in the order that mixed(seed, key) gives its group; equal keys by the whole row's hash."""
    rows = df.withColumns({"_h": F.coalesce(mixed(seed, key), F.lit(0)), "_g": F.xxhash64(*df.columns)})  # never NULL, so hashed once, without a filter
    return numbered(rows, by, "_h", name, ties=["_g"], piece=F.shiftright("_h", 52)).drop("_h", "_g")  # mixed numbers are even: 256 pieces
