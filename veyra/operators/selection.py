"""Feature scores, effect sizes, contrasts, corrections and stability indices as DataFrame plans."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veyra.functions.dist import NORMAL, t_quantile, t_two_sided, wilcoxon

from .ordered import counted, cumulate, cut, join_on, numbered, quantiles, running
from .survey import brr_clustered, brr_statistic, finite


def unpivot(df: DataFrame, keep: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keep, feature, value): statistics of all features run on this one relation."""
    return df.unpivot(list(keep), [F.col(f).cast("double").alias(f) for f in features], "feature", "value")


def bin_marks(long: DataFrame, bins: int = 10) -> DataFrame:
    """(feature, marks, dense): the values themselves where a feature has at most bins, else its distinct quantile cuts."""
    cells = counted(long.where(finite(F.col("value")).isNotNull()), ["feature"], "value")
    kinds = cells.groupBy("feature").agg(F.count("*").alias("_k"))
    few = cells.join(F.broadcast(kinds), "feature").where(F.col("_k") <= bins).groupBy("feature").agg(F.array_sort(F.collect_list("value")).alias("few"))
    cuts = quantiles(cells, ["feature"], "value", [i / bins for i in range(1, bins)])
    return cuts.join(few, "feature", "left").select("feature", F.coalesce("few", F.array_distinct("cuts")).alias("marks"), F.col("few").isNotNull().cast("int").alias("dense"))


def decile_bins(long: DataFrame, bins: int = 10) -> DataFrame:
    """Adds bin: a dense code where a feature has few distinct values, else the number of distinct quantile cuts at or
    below; NULL for values that aren't finite. Marks, one row a feature, are sent to every task: no row is shuffled."""
    joined = long.join(F.broadcast(bin_marks(long, bins)), "feature", "left")
    return joined.withColumn("bin", F.when(finite(F.col("value")).isNotNull(), F.size(F.filter("marks", lambda c: c <= F.col("value"))) - F.col("dense"))).drop("marks", "dense")


def entropy(df: DataFrame, by: Sequence[str], code: str) -> DataFrame:
    """In nats, of codes that are known and not negative; each group with such a code has one row."""
    n = df.where(F.col(code) >= 0).groupBy(*by, code).agg(F.count("*").alias("c"))
    total = n.withColumn("t", F.sum("c").over(Window.partitionBy(*by)))
    return total.groupBy(*by).agg(F.sum(-F.col("c") / F.col("t") * F.ln(F.col("c") / F.col("t"))).alias("entropy"))


def conditional_entropy(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """H(x given y) over rows that have both, from one contingency table."""
    n = df.where((F.col(x) >= 0) & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count("*").cast("double").alias("c"))
    cells = n.withColumns({"t": F.sum("c").over(Window.partitionBy(*by)), "s": F.sum("c").over(Window.partitionBy(*by, y))})
    return cells.groupBy(*by).agg(F.sum(-F.col("c") / F.col("t") * F.ln(F.col("c") / F.col("s"))).alias("conditional_entropy"))


def information(binned: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """mi = max(H(x) - H(x given y), 0) and su = 2 mi / (H(x) + H(y)), cut to 0 to 1 (0 where both are constant). H(x) and
    H(y) are over the rows that have them, H(x given y) over rows that have both."""
    n = binned.groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").cast("double").alias("c"))

    def part(known: Column, *keys: str) -> Column:
        return F.sum(F.when(known, F.col("c"))).over(Window.partitionBy(*by, *keys))

    hx, hy, both = F.col("_x").isNotNull(), F.col("_y").isNotNull(), F.col("_x").isNotNull() & F.col("_y").isNotNull()
    cells = n.withColumns({"tx": part(hx), "ty": part(hy), "tb": part(both), "sx": part(hx, "_x"), "sy": part(hy, "_y"), "syb": part(both, "_y")})
    share = lambda t: F.col("c") / F.col(t)
    got = cells.groupBy(*by).agg(
        F.sum(F.when(hx, -share("tx") * F.ln(F.col("sx") / F.col("tx")))).alias("hx"),
        F.sum(F.when(hy, -share("ty") * F.ln(F.col("sy") / F.col("ty")))).alias("hy"),
        F.sum(F.when(both, -share("tb") * F.ln(F.col("c") / F.col("syb")))).alias("hxy"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    mi = F.greatest(zero(F.col("hx")) - zero(F.col("hxy")), F.lit(0.0))
    su = zero(F.try_divide(2 * mi, zero(F.col("hx")) + zero(F.col("hy"))))
    return got.select(*by, mi.alias("mi"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), su)).alias("su"))


def symmetric_uncertainty(binned: DataFrame, label: str) -> DataFrame:
    """feature, mi, su of every feature with a label of few values, from one contingency table of all features."""
    return information(binned, ["feature"], "bin", label)


def su_matrix(df: DataFrame, features: Sequence[str], bins: int = 10) -> DataFrame:
    """(a, b, su) of all pairs of features in both directions, 1 on the diagonal. Each row gives its pairs of bins, summed
    in every task: no row meets another, and what is shuffled is at most bins^2 cells for each pair and task."""
    marks = bin_marks(unpivot(df, [], features), bins).agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("marks", "dense")))).alias("_m"))
    wide = df.select(*[finite(F.col(f"`{f}`").cast("double")).alias(f"_{i}") for i, f in enumerate(features)]).crossJoin(F.broadcast(marks))

    def code(i: int) -> Column:
        m = F.col("_m")[features[i]]
        return F.when(F.col(f"_{i}").isNotNull(), F.size(F.filter(m["marks"], lambda c: c <= F.col(f"_{i}"))) - m["dense"])

    codes = wide.select(F.array(*[code(i) for i in range(len(features))]).alias("_c"))
    names = F.array(*map(F.lit, features))
    pairs = F.flatten(F.transform("_c", lambda x, i: F.transform(F.slice("_c", i + 2, len(features)), lambda y, j: F.struct(i.alias("i"), (i + j + 1).alias("j"), x.alias("x"), y.alias("y")))))
    got = information(codes.select(F.explode(pairs).alias("p")).select("p.*"), ["i", "j"], "x", "y")
    each = got.select(F.explode(F.array(F.struct(F.col("i").alias("i"), F.col("j").alias("j")), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("p"), "su")
    both = each.select(names[F.col("p.i")].alias("a"), names[F.col("p.j")].alias("b"), "su")
    return both.unionByName(df.sparkSession.createDataFrame([(f, f, 1.0) for f in features], "a string, b string, su double"))


def chi2(long: DataFrame, label: str) -> DataFrame:
    """Sum over classes of (observed - expected)^2 / expected on class sums of each feature, shifted to start at 0."""
    low = long.groupBy("feature").agg(F.least(F.min("value"), F.lit(0.0)).alias("low"))
    sums = long.join(F.broadcast(low), "feature").groupBy("feature", label).agg(F.sum(F.coalesce("value", F.lit(0.0)) - F.col("low")).alias("o"), F.count("*").alias("k"))
    w = Window.partitionBy("feature")
    got = sums.withColumn("e", F.sum("o").over(w) * F.col("k") / F.sum("k").over(w))
    return got.groupBy("feature").agg(F.sum(F.try_divide(F.pow(F.col("o") - F.col("e"), 2), F.col("e"))).alias("chi2"))


def top_k(scores: DataFrame, score: str, k: int) -> DataFrame:
    """The k best with their rank; ties to the name."""
    return scores.orderBy(F.desc_nulls_last(score), "feature").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(score), "feature")))


def _pooled(n1: Column, n0: Column, v1: Column, v0: Column) -> Column:
    return F.sqrt(F.try_divide((n1 - 1) * v1 + (n0 - 1) * v0, (n1 + n0 - 2).cast("double")))


def cohens_d(df: DataFrame, by: Sequence[str], x: str, group: str) -> DataFrame:
    """Independent groups 1 and 0: d, hedges_g and the band of |d|; groups of fewer than two give NULL."""
    a, b = F.when(F.col(group) == 1, F.col(x)), F.when(F.col(group) == 0, F.col(x))
    s = df.groupBy(*by).agg(F.avg(a).alias("m1"), F.avg(b).alias("m0"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v0"), F.count(a).alias("n1"), F.count(b).alias("n0"))
    out = s.withColumn("d", F.try_divide(F.col("m1") - F.col("m0"), _pooled(F.col("n1"), F.col("n0"), F.col("v1"), F.col("v0"))))
    return out.withColumns({"hedges_g": F.col("d") * (1 - 3 / (4.0 * (F.col("n1") + F.col("n0") - 2) - 1)), "band": interpret_d(F.col("d"))}).select(*by, "d", "hedges_g", "band")


def difference_values(x: Column, group: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    """What a weighted difference of groups 1 and 0 sums times the weight, and what it counts."""
    values, counts = {}, {}
    for k in (1, 0):
        own = (group == k) & x.isNotNull()
        values |= {f"n{k}_": F.when(group == k, 1.0), f"w{k}_": F.when(own, 1.0), f"s{k}_": F.when(own, x), f"q{k}_": F.when(own, x * x)}
        counts[f"c{k}_"] = F.when(own, 1).otherwise(0)
    return values, counts


def difference(c) -> Column:
    """The weighted standardised difference from the sums of difference_values: variances of the population, pooled by sums of weights;
    NULL where a group has fewer than two rows or there is no spread."""
    mean = {k: F.try_divide(c(f"s{k}_"), c(f"w{k}_")) for k in (1, 0)}
    var = {k: F.try_divide(c(f"q{k}_"), c(f"w{k}_")) - mean[k] * mean[k] for k in (1, 0)}
    spread = ((c("n1_") - 1) * var[1] + (c("n0_") - 1) * var[0]) / F.greatest(c("n1_") + c("n0_") - 2, F.lit(1e-9))
    return F.when((c("c1_") >= 2) & (c("c0_") >= 2) & (spread > 0), F.try_divide(mean[1] - mean[0], F.sqrt(spread)))


def group_differences(long: DataFrame, group: str, weight: Column | None = None, replicates: Sequence[Column] = (), cluster: str | None = None) -> DataFrame:
    """Every feature's standardised difference, largest first: unweighted with g, or weighted, with replicate errors (with
    cluster, replicates are factors of the weight within it)."""
    if weight is None:
        return cohens_d(long, ["feature"], "value", group).orderBy(F.desc_nulls_last(F.abs("d")), "feature")
    values, counts = difference_values(F.col("value"), F.col(group))
    if replicates and cluster is not None:
        out = brr_clustered(long, ["feature"], values, counts, difference, cluster, weight, replicates).withColumnRenamed("estimate", "d")
    elif replicates:
        sums = lambda w: {n: F.sum(v * w) for n, v in values.items()} | {n: F.sum(c) for n, c in counts.items()}
        out = brr_statistic(long, ["feature"], sums, weight, replicates, finish=difference).withColumnRenamed("estimate", "d")
    else:
        sums = [F.sum(v * weight).alias(n) for n, v in values.items()] + [F.sum(c).alias(n) for n, c in counts.items()]
        out = long.groupBy("feature").agg(*sums).select("feature", difference(F.col).alias("d"))
    return out.withColumn("band", interpret_d(F.col("d"))).orderBy(F.desc_nulls_last(F.abs("d")), "feature")


def interpret_d(d: Column) -> Column:
    """Bands of the absolute value (fixed values 0.2, 0.5, 0.8)."""
    size = F.abs(d)
    return F.when(d.isNull(), "undefined").when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")


def paired_contrasts(folds: DataFrame, keys: Sequence[str], method: str, value: str, reference: str, ratio: float, *, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Every other method against the reference on shared folds, in each family of by: mean difference, paired d, and t, p
    and interval corrected for overlapping training sets (ratio: test to training rows; 0 gives the plain paired t)."""
    if ratio is None:
        raise ValueError("the corrected t needs the ratio of test to training rows")
    a, b = folds.where(F.col(method) != reference), folds.where(F.col(method) == reference).select(*by, *keys, F.col(value).alias("_r"))
    diff = join_on(a, b, [*by, *keys]).withColumn("_d", finite(F.col(value) - F.col("_r"))).where(F.col("_d").isNotNull())
    s = diff.groupBy(*by, method).agg(F.count("*").alias("n"), F.avg("_d").alias("mean_diff"), F.var_samp("_d").alias("v"), F.collect_list("_d").alias("_all"))
    se = F.sqrt((1 / F.col("n") + ratio) * F.col("v"))
    out = s.withColumns({"d_paired": F.try_divide(F.col("mean_diff"), F.sqrt("v")), "t_corrected": F.try_divide(F.col("mean_diff"), se), "t_plain": F.try_divide(F.col("mean_diff"), F.sqrt(F.col("v") / F.col("n"))), "df": F.when(F.col("n") > 1, F.col("n") - 1), "_se": se})
    half = t_quantile(F.lit(1 - alpha / 2), F.col("df")) * F.col("_se")
    out = out.withColumns({"p_corrected": t_two_sided(F.col("t_corrected"), F.col("df")), "p_plain": t_two_sided(F.col("t_plain"), F.col("df")), "p_wilcoxon": signed_rank_p("_all"), "ci_low": F.col("mean_diff") - half, "ci_high": F.col("mean_diff") + half, "band": interpret_d(F.col("d_paired"))})
    return out.select(*by, method, "n", "mean_diff", "d_paired", "band", "t_corrected", "t_plain", "df", "p_corrected", "p_plain", "p_wilcoxon", "ci_low", "ci_high")


def contrast_table(folds: DataFrame, keys: Sequence[str], method: str, value: str, reference: str, ratio: float, *, by: Sequence[str] = (), test: str = "nadeau_bengio", correction: str = "holm", alpha: float = 0.05) -> DataFrame:
    """paired_contrasts with p of the test, corrected within each family, and whether it is below alpha. Methods without a
    shared fold have no row."""
    kinds = {"nadeau_bengio": "p_corrected", "paired_t": "p_plain", "wilcoxon": "p_wilcoxon"}
    if test not in kinds or correction not in ("holm", "bh"):
        raise ValueError(f"unknown test or correction: {test!r}, {correction!r}")
    rows = paired_contrasts(folds, keys, method, value, reference, ratio, by=by, alpha=alpha).withColumn("p", F.col(kinds[test]))
    out = adjust(rows, by, "p", method).withColumn("p_adj", F.col(correction)).drop("holm", "bh", *kinds.values())
    return out.withColumns({"reference": F.lit(reference), "test": F.lit(test), "correction": F.lit(correction), "significant": F.coalesce(F.col("p_adj") < alpha, F.lit(False))})


def signed_rank_p(differences: str) -> Column:
    """Two-sided p of the signed-rank test on an array of differences (one for each fold: few)."""
    def over(all_d: pd.Series) -> pd.Series:
        return pd.Series([wilcoxon([float(x) for x in d])[1] for d in all_d], dtype=float)

    return F.nanvl(F.pandas_udf(over, "double")(F.col(differences)), F.lit(None).cast("double"))


def adjust(tests: DataFrame, family: Sequence[str], p: str, tie: str) -> DataFrame:
    """Holm (running maximum) and Benjamini-Hochberg (running minimum from the top) within each family; NULL p stay.

    Equal p of a family have equal values in whatever order of tie: the first of them has the largest step of Holm's, the
    last the least of the other's. So distinct p are put in order, and rows meet them again."""
    cells = tests.where(F.col(p).isNotNull()).groupBy(*family, p).agg(F.count("*").alias("n"))
    order = cumulate(cut(cells, family, p, totals={"_m": "n"}, name="_at"), family, p, ["n"], piece=F.col("_at"))
    steps = running(order, family, p, {"_holm": (F.col("_m") - F.col("below_n")) * F.col(p)}, {"_bh": F.col("_m") / (F.col("below_n") + F.col("n")) * F.col(p)}, F.col("_at"))
    got = steps.select(*family, p, F.least(F.lit(1.0), "_holm").alias("holm"), F.least(F.lit(1.0), "_bh").alias("bh"))
    return join_on(tests, got, [*family, p], "left")


def jaccard(x: Column, y: Column) -> Column:
    """NULL where both are empty."""
    return F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)).cast("double"))


def kuncheva(x: Column, y: Column, n_total: int) -> Column:
    """NULL unless sizes agree and lie between none and all of n_total."""
    both, k = F.size(F.array_intersect(x, y)).cast("double"), F.size(x).cast("double")
    return F.when((F.size(x) == F.size(y)) & (k > 0) & (k < n_total), F.try_divide(both * n_total - k * k, k * (n_total - k)))


def pairwise_stability(subsets: DataFrame, by: Sequence[str], fold: str, names: str, n_total: int) -> DataFrame:
    """Of all pairs of folds in each group: n_subsets, mean, SD and number of known values of both indices, and sizes.
    Folds of a group are few by design; a group of one has no pairs and NULL indices."""
    sets = subsets.select(*by, fold, F.array_distinct(names).alias("_names"))
    other = sets.select(*by, F.col(fold).alias("_f"), F.col("_names").alias("_other"))
    pairs = join_on(sets, other, by).where(F.col(fold) < F.col("_f"))
    x, y = F.col("_names"), F.col("_other")
    pairs = pairs.withColumns({"jaccard": jaccard(x, y), "kuncheva": kuncheva(x, y, n_total)})
    indices = pairs.groupBy(*by).agg(F.count("*").alias("n_pairs"), *[f(c).alias(f"{c}_{k}") for c in ("jaccard", "kuncheva") for k, f in (("mean", F.avg), ("sd", F.stddev_samp), ("n_pairs", F.count))])
    size = F.size("_names")
    sizes = sets.groupBy(*by).agg(F.count("*").alias("n_subsets"), F.avg(size).alias("size_mean"), F.coalesce(F.stddev_samp(size), F.lit(0.0)).alias("size_sd"), F.min(size).alias("size_min"), F.max(size).alias("size_max"))
    out = join_on(sizes, indices, by, "left") if by else sizes.crossJoin(indices)
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_pairs", "jaccard_n_pairs", "kuncheva_n_pairs")})


def wilson(p: Column, n: Column, z: float) -> tuple[Column, Column]:
    base, mid = 1 + z * z / n, p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / base, (mid + half) / base


def selection_frequency(subsets: DataFrame, names: str, features: DataFrame | None = None, *, by: Sequence[str] = (), threshold: float = 0.8, alpha: float = 0.05) -> DataFrame:
    """Share of folds that chose each feature, most frequent first, with Wilson's interval. features (column feature) lists
    all of them, so that those never chosen have a row."""
    total = subsets.groupBy(*by).agg(F.count("*").cast("double").alias("n"))
    got = subsets.select(*by, F.explode(F.array_distinct(names)).alias("feature")).groupBy(*by, "feature").agg(F.count("*").cast("double").alias("count"))
    every = total.crossJoin(features.select("feature").distinct()) if features is not None else join_on(total, got.select(*by, "feature").distinct(), by)
    out = join_on(every, got, [*by, "feature"], "left").withColumn("count", F.coalesce("count", F.lit(0.0))).withColumn("p", F.col("count") / F.col("n"))
    low, high = wilson(F.col("p"), F.col("n"), NORMAL.inv_cdf(1 - alpha / 2))
    out = out.select(*by, "feature", "count", "p", low.alias("low"), high.alias("high"), (F.col("p") >= threshold).alias("consensus"))
    return out.orderBy(*by, F.desc("p"), "feature")


def stability_table(subsets: DataFrame, by: Sequence[str], fold: str, names: str, features: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """pairwise_stability with the features that the share of folds makes consensual, joined by commas in order."""
    n_total = features.select("feature").distinct().count()
    often = selection_frequency(subsets, names, features, by=by, threshold=threshold).where("consensus")
    agreed = often.groupBy(*by).agg(F.count("*").alias("n_consensus"), F.array_sort(F.collect_list(F.struct(-F.col("p"), "feature"))).alias("_f"))
    agreed = agreed.select(*by, "n_consensus", F.array_join(F.transform("_f", lambda x: x["feature"]), ", ").alias("consensus_features"))
    out = join_on(pairwise_stability(subsets, by, fold, names, n_total), agreed, by, "left")
    return out.withColumns({"n_consensus": F.coalesce("n_consensus", F.lit(0)), "consensus_features": F.coalesce("consensus_features", F.lit(""))})


def islands(df: DataFrame, index: str, flag: Column) -> DataFrame:
    """Runs of rows with the flag: first index and length."""
    runs = numbered(df.where(flag).select(F.col(index).alias("_i")), [], "_i", "_k").withColumn("_g", F.col("_i") - F.col("_k"))
    return runs.groupBy("_g").agg(F.min("_i").alias("start"), F.count("*").alias("length")).drop("_g")
