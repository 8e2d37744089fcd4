"""Weighted, replicated and rank-based statistics as DataFrame plans. Missing is NULL; a 0/0 is NULL unless stated."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veyra.functions.dist import t_quantile

from .ordered import counted, cumulate, join_on, quantiles
from .replicates import replicated_auc


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def categorize(x: Column, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the number of cuts at or below x; NULL stays NULL."""
    out = F.when(x < cuts[0], labels[0])
    for cut, label in zip(cuts[1:], labels[1:]):
        out = out.when(x < cut, label)
    return out.when(x.isNotNull(), labels[-1])


def pv_categories(df: DataFrame, template: str, m: int, cuts: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """Adds cat_pv1 to cat_pvM, replacing any before; template names the plausible values, as PV{i}MATH."""
    names = [template.format(i=i) for i in range(1, m + 1)]
    if gone := [n for n in names if n not in df.columns]:
        raise KeyError(f"plausible values not in the table: {gone}")
    return df.drop(*[c for c in df.columns if c.startswith("cat_pv")]).withColumns({f"cat_pv{i}": categorize(F.col(f"`{n}`"), cuts, labels) for i, n in enumerate(names, 1)})


def task_rows(df: DataFrame, category: str, negative: str, positive: str) -> DataFrame:
    """Rows of the two categories of a task, with y."""
    return df.where(F.col(category).isin(negative, positive)).withColumn("y", task_label(F.col(category), negative, positive))


def legacy_category(scores: Sequence[Column], cuts: Sequence[float], labels: Sequence[str]) -> Column:
    """Categories of the mean of plausible values with the cuts inside the lower class; for audits of reclassification only."""
    mean = sum(scores[1:], scores[0]) / len(scores)
    out = F.when(mean <= cuts[0], labels[0])
    for cut, label in zip(cuts[1:], labels[1:]):
        out = out.when(mean <= cut, label)
    return out.when(mean.isNotNull(), labels[-1])


def missing_count(columns: Sequence[str], kinds: dict[str, str] | None = None) -> Column:
    """How many of the columns are NULL, or NaN where their kind is a floating one."""
    kinds = kinds or {}
    return sum((F.col(f"`{c}`").isNull() | (F.isnan(f"`{c}`") if kinds.get(c) in ("double", "float") else F.lit(False))).cast("int") for c in columns)


def task_label(category: Column, negative: str, positive: str) -> Column:
    return F.when(category == negative, 0).when(category == positive, 1)


def weighted_mean(x: Column, w: Column) -> Column:
    return F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def weighted_moments(df: DataFrame, by: Sequence[str], x: str, w: str) -> DataFrame:
    """wmean, wvar (population, two passes) and wstd for each group."""
    means = df.groupBy(*by).agg(weighted_mean(F.col(x), F.col(w)).alias("wmean"))
    spread = df.join(F.broadcast(means) if not by else means, list(by)) if by else df.crossJoin(F.broadcast(means))
    out = spread.groupBy(*by, "wmean").agg(weighted_mean(F.pow(F.col(x) - F.col("wmean"), 2), F.col(w)).alias("wvar"))
    return out.withColumn("wstd", F.sqrt("wvar"))


def brr_statistic(df: DataFrame, by: Sequence[str], statistic: Callable, weight: Column, replicates: Sequence[Column], fay_k: float = 0.5, finish: Callable | None = None) -> DataFrame:
    """estimate, brr_variance, brr_se, ci_low, ci_high, n_replicates_used, fay_k of any aggregate of a weight.

    statistic gives the aggregate for a weight column; or, with finish, named sums, from which finish makes the statistic
    (it is given a function from name to column). All replicates are aggregates of one pass over the rows as they are,
    partial in every task, so what is shuffled is one row for each group and task."""
    names = [f"_w{i}" for i in range(len(replicates) + 1)]
    df = df.withColumns(dict(zip(names, [weight, *replicates])))  # once a row, however many sums use them
    weights = [F.col(n) for n in names]
    if finish is None:
        each = df.groupBy(*by).agg(*[finite(statistic(w)).alias(f"_t{i}") for i, w in enumerate(weights)])
    else:
        sums = df.groupBy(*by).agg(*[a.alias(f"_{n}{i}") for i, w in enumerate(weights) for n, a in statistic(w).items()])
        each = sums.select(*by, *[finite(finish(lambda n, i=i: F.col(f"_{n}{i}"))).alias(f"_t{i}") for i in range(len(weights))])
    return _brr_summary(each.select(*by, F.col("_t0").alias("estimate"), F.array(*[f"_t{i + 1}" for i in range(len(replicates))]).alias("_all")), by, fay_k)


def brr_clustered(df: DataFrame, by: Sequence[str], values: Mapping[str, Column], counts: Mapping[str, Column], finish: Callable, cluster: str, weight: Column, factors: Sequence[Column], fay_k: float = 0.5) -> DataFrame:
    """brr_statistic where replicate weights are the weight times a factor that is the same within a cluster.

    values give what is summed times the weight, counts what is summed as it is; finish makes the statistic of the sums.
    Rows are read into one row for each group and cluster, with the sums under the full weight; only those rows meet the
    factors (columns of the cluster), so a row costs a few sums however many replicates there are."""
    sums = df.groupBy(*by, cluster).agg(*[F.sum(v * weight).alias(f"_s_{n}") for n, v in values.items()], *[F.sum(c).alias(f"_c_{n}") for n, c in counts.items()])
    every = [F.lit(1.0), *factors]
    each = sums.groupBy(*by).agg(*[F.sum(F.col(f"_s_{n}") * f).alias(f"_{n}{i}") for i, f in enumerate(every) for n in values], *[F.sum(f"_c_{n}").alias(f"_{n}") for n in counts])
    each = each.select(*by, *[finite(finish(lambda n, i=i: F.col(f"_{n}{i}" if n in values else f"_{n}"))).alias(f"_t{i}") for i in range(len(every))])
    return _brr_summary(each.select(*by, F.col("_t0").alias("estimate"), F.array(*[f"_t{i + 1}" for i in range(len(factors))]).alias("_all")), by, fay_k)


def _brr_summary(each: DataFrame, by: Sequence[str], fay_k: float) -> DataFrame:
    """Replicates that aren't finite are left out; fewer than two are an error when the row is computed."""
    out = each.withColumn("_all", F.filter("_all", lambda t: t.isNotNull())).withColumn("n_replicates_used", F.size("_all").cast("long"))
    squares = F.aggregate("_all", F.lit(0.0), lambda s, t: s + F.pow(t - F.col("estimate"), 2))
    few = F.raise_error(F.concat(F.lit("fewer than two usable replicates: "), F.col("n_replicates_used").cast("string"))).cast("double")
    out = out.withColumn("brr_variance", F.when(F.col("n_replicates_used") >= 2, squares / (F.col("n_replicates_used") * (1 - fay_k) ** 2)).otherwise(few)).withColumn("brr_se", F.sqrt("brr_variance"))
    return out.select(*by, "estimate", "brr_variance", "brr_se", (F.col("estimate") - 1.96 * F.col("brr_se")).alias("ci_low"), (F.col("estimate") + 1.96 * F.col("brr_se")).alias("ci_high"), "n_replicates_used", F.lit(fay_k).alias("fay_k"))


def brr(df: DataFrame, by: Sequence[str], x: Column, weight: Column, replicates: Sequence[Column], fay_k: float = 0.5, cluster: str | None = None) -> DataFrame:
    """brr_statistic of the weighted mean of x. With cluster, replicates are factors of the weight within it."""
    if cluster is not None:
        return brr_clustered(df, by, {"s": x, "w": F.when(x.isNotNull(), 1.0)}, {}, lambda c: F.try_divide(c("s"), c("w")), cluster, weight, replicates, fay_k)
    sums = lambda w: {"s": F.sum(x * w), "w": F.sum(F.when(x.isNotNull(), w))}
    return brr_statistic(df, by, sums, weight, replicates, fay_k, lambda c: F.try_divide(c("s"), c("w")))


def brr_shares(df: DataFrame, by: Sequence[str], category: Column, labels: Sequence[str], weight: Column, replicates: Sequence[Column], fay_k: float = 0.5) -> DataFrame:
    """brr of the weighted share of each category, in (by, category); a row adds its weights to its own category only."""
    names = [f"_w{i}" for i in range(len(replicates) + 1)]
    sums = df.select(*by, category.alias("category"), *[w.alias(n) for n, w in zip(names, [weight, *replicates])]).groupBy(*by, "category").agg(*[F.sum(n).alias(n) for n in names])
    known = sums.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("category", F.lit("")), F.array(*names)))).alias("_m"), F.array(*[F.sum(n) for n in names]).alias("_s"))
    rows = known.withColumn("category", F.explode(F.array(*map(F.lit, labels)))).withColumn("_c", F.element_at("_m", F.col("category")))
    shares = F.zip_with(F.coalesce("_c", F.array_repeat(F.lit(0.0), len(names))), "_s", lambda c, s: finite(F.try_divide(c, s)))
    each = rows.withColumn("_x", shares).select(*by, "category", F.col("_x")[0].alias("estimate"), F.slice("_x", 2, len(replicates)).alias("_all"))
    return _brr_summary(each, [*by, "category"], fay_k)


def brr_auc(df: DataFrame, by: Sequence[str], label: str, score: str, weight: Column, replicates: Sequence[Column], fay_k: float = 0.5) -> DataFrame:
    """brr of the weighted AUC: one order of the scores serves all replicates, whose weights are made where rows are summed."""
    rows = df.where(F.col(label).isin(0, 1) & finite(F.col(score).cast("double")).isNotNull())
    y, weights = F.col(label) == 1, [w.cast("double") for w in (weight, *replicates)]
    tops = replicated_auc(rows, by, score, y, ~y, weights, np.stack, len(weights))
    return _brr_summary(tops.select(*by, F.col("t")[0].alias("estimate"), F.slice("t", 2, len(replicates)).alias("_all")), by, fay_k)


def sample_flow(df: DataFrame, missing: str, psu: str, thresholds: Sequence[int]) -> DataFrame:
    """Rows and clusters at each missingness threshold, in one pass."""
    steps = df.select(missing, psu, F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).where(F.col(missing) <= F.col("threshold"))
    return steps.groupBy("threshold").agg(F.count("*").alias("n"), F.countDistinct(psu).alias("n_psu"))


def design_diagnostics(df: DataFrame, psu: str, w: str, stratum: str, n_replicates: int = 0) -> DataFrame:
    """Rows, clusters and their sizes, weights with their population CV, Kish's effective size, design effect, strata."""
    each = df.groupBy(psu).agg(F.count("*").alias("c"), F.sum(w).alias("s"), F.sum(F.pow(w, F.lit(2))).alias("q"), F.min(w).alias("lo"), F.max(w).alias("hi"))
    strata = df.agg(F.countDistinct(stratum).alias("n_strata"))
    out = each.agg(F.sum("c").alias("n"), F.count("*").alias("n_psu"), F.avg("c").alias("mean_per_psu"), F.min("c").alias("min_per_psu"), F.max("c").alias("max_per_psu"), F.sum("s").alias("sum_w"), F.sum("q").alias("_q"), F.min("lo").alias("min_w"), F.max("hi").alias("max_w"))
    mean = F.col("sum_w") / F.col("n")
    out = out.withColumn("cv_w", F.try_divide(F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / F.col("n") - mean * mean)), mean))
    out = out.withColumn("kish_n", F.try_divide(F.col("sum_w") * F.col("sum_w"), F.col("_q")))
    return out.withColumn("deff", F.try_divide(F.col("n"), F.col("kish_n"))).withColumn("n_replicates", F.lit(n_replicates).cast("long")).drop("_q").crossJoin(F.broadcast(strata))


def normalised_weights(df: DataFrame, w: str) -> DataFrame:
    """Weights that sum to the number of rows; totals are one aggregated row."""
    totals = df.agg(F.count("*").alias("_n"), F.sum(w).alias("_s"))
    return df.crossJoin(F.broadcast(totals)).withColumn("w_norm", F.try_divide(F.col(w) * F.col("_n"), F.col("_s"))).drop("_n", "_s")


def instability(df: DataFrame, categories: Sequence[str], labels: Sequence[str], w: Column) -> DataFrame:
    """Weighted shares over rows whose categories differ between plausible values; nothing is shuffled by row."""
    known = F.array_compact(F.array(*categories))
    modal = F.array_max(F.array(*[_count(known, x) for x in labels]))
    unstable = (F.size(F.array_distinct(known)) > 1).cast("double")
    share = F.try_divide(modal.cast("double"), F.size(known).cast("double"))
    return df.agg(weighted_mean(unstable, w).alias("unstable"), weighted_mean(share, w).alias("modal_share"), weighted_mean(1 - unstable, w).alias("stable"))


def _count(values: Column, label: str) -> Column:
    return F.size(F.filter(values, lambda c: c == label))


def rubin(df: DataFrame, by: Sequence[str], estimate: str, variance: str) -> DataFrame:
    """Rubin's rules without the interval: q_bar, within, between, total_var, se, riv, df, fmi."""
    out = df.groupBy(*by).agg(F.avg(estimate).alias("q_bar"), F.coalesce(F.avg(variance), F.lit(0.0)).alias("within"), F.coalesce(F.var_samp(estimate), F.lit(0.0)).alias("between"), F.count(estimate).alias("m"))
    extra = (1 + 1 / F.col("m")) * F.col("between")
    out = out.withColumn("total_var", F.col("within") + extra).withColumn("se", F.sqrt("total_var"))
    return out.withColumns({"riv": F.try_divide(extra, F.col("within")), "df": (F.col("m") - 1) * F.pow(1 + F.try_divide(F.col("within"), extra), 2), "fmi": F.coalesce(F.try_divide(extra, F.col("total_var")), F.lit(0.0))})


def rubin_intervals(df: DataFrame, by: Sequence[str], estimate: str, variance: str, alpha: float = 0.05) -> DataFrame:
    """rubin() with ci_low and ci_high: Student quantiles, normal ones where the estimates don't differ."""
    out = rubin(df, by, estimate, variance)
    normal = (F.col("m") < 2) | (F.col("between") == 0) | (F.col("within") == 0) & (F.col("between") == 0)
    out = out.withColumns({"df": F.when(normal, float("inf")).otherwise(F.col("df")), "riv": F.when(normal, 0.0).when(F.col("within") == 0, float("inf")).otherwise(F.col("riv")), "fmi": F.when(normal, 0.0).otherwise(F.col("fmi"))})
    half = t_quantile(F.lit(1 - alpha / 2), F.col("df")) * F.col("se")
    return out.withColumns({"ci_low": F.col("q_bar") - half, "ci_high": F.col("q_bar") + half})


def _ranked(df: DataFrame, by: Sequence[str], label: str, score: str, w: Column) -> DataFrame:
    """Positive and negative weight at each distinct score: what the global order works on."""
    return df.groupBy(*by, F.col(score).alias("_s")).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("_p"), F.sum(F.when(F.col(label) == 0, w).otherwise(0.0)).alias("_n"))


def auc(df: DataFrame, by: Sequence[str], label: str, score: str, w: Column | None = None) -> DataFrame:
    """Tie-aware weighted ROC AUC for each group, with n_used (rows with a finite score and a label)."""
    sound = df.where(finite(F.col(score).cast("double")).isNotNull() & F.col(label).isNotNull())
    each = cumulate(_ranked(sound, by, label, score, F.lit(1.0) if w is None else w), by, "_s", ["_n"])
    got = each.groupBy(*by).agg(F.sum(F.col("_p") * (F.col("below__n") + F.col("_n") / 2)).alias("_u"), F.sum("_p").alias("_tp"), F.sum("_n").alias("_tn"))
    return got.select(*by, F.try_divide(F.col("_u"), F.col("_tp") * F.col("_tn")).alias("auc"))


def average_precision(df: DataFrame, by: Sequence[str], label: str, score: str, w: Column | None = None) -> DataFrame:
    each = _ranked(df.where(finite(F.col(score).cast("double")).isNotNull()), by, label, score, F.lit(1.0) if w is None else w).withColumn("_d", -F.col("_s"))
    got = cumulate(each, by, "_d", ["_p", "_n"]).withColumns({"_cp": F.col("below__p") + F.col("_p"), "_cn": F.col("below__n") + F.col("_n")})
    return got.groupBy(*by).agg(F.try_divide(F.sum(F.try_divide(F.col("_p") * F.col("_cp"), F.col("_cp") + F.col("_cn"))), F.sum("_p")).alias("ap"))


def confusion_metrics(df: DataFrame, by: Sequence[str], label: str, score: Column, threshold: float, w: Column) -> DataFrame:
    """Weighted confusion counts at a threshold and what follows from them; 0/0 is 0. brier takes scores cut to 0 to 1."""
    y, hit = F.col(label) == 1, score >= threshold
    cells = {"tp": y & hit, "fn": y & ~hit, "fp": ~y & hit, "tn": ~y & ~hit}
    off = F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) - F.col(label), F.lit(2))
    out = df.groupBy(*by).agg(*[F.sum(F.when(c, w).otherwise(0.0)).alias(n) for n, c in cells.items()], F.count("*").alias("n"), weighted_mean(off, w).alias("brier"))
    tp, fn, fp, tn = map(F.col, ("tp", "fn", "fp", "tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.withColumns({"accuracy": ratio(tp + tn, tp + fn + fp + tn), "recall": ratio(tp, tp + fn), "precision": ratio(tp, tp + fp), "specificity": ratio(tn, tn + fp), "fnr": ratio(fn, fn + tp), "fpr": ratio(fp, fp + tn), "prevalence": ratio(tp + fn, tp + fn + fp + tn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})
    return out.withColumns({"balanced_accuracy": (F.col("recall") + F.col("specificity")) / 2, "threshold": F.lit(float(threshold))})


def classification_metrics(df: DataFrame, by: Sequence[str], label: str, score: str, threshold: float, w: Column | None = None) -> DataFrame:
    """confusion_metrics, auc and average precision in one row for each group; weighted tells whether w was given."""
    out = confusion_metrics(df, by, label, F.col(score), threshold, F.lit(1.0) if w is None else w)
    for other in (auc(df, by, label, score, w), average_precision(df, by, label, score, w)):
        out = join_on(out, other, by, "left") if by else join_on(out, other, by)
    return out.withColumn("weighted", F.lit(w is not None))


def select_threshold(df: DataFrame, label: str, score: Column, grid: Sequence[float] | None = None, metric: str = "balanced_accuracy", w: Column | None = None) -> DataFrame:
    """The lowest threshold of the best value (balanced_accuracy or f1), among the 99 percentiles of the score or a grid.

    Rows fall between thresholds once; sums over what lies at or above each threshold follow from the few cells."""
    if metric not in ("balanced_accuracy", "f1"):
        raise ValueError(f"unknown metric {metric!r}")
    rows = df.select(F.col(label).alias("y"), score.cast("double").alias("s"), (F.lit(1.0) if w is None else w).alias("w")).where("s is not null and y is not null")
    if grid is None:
        cuts = quantiles(counted(rows, [], "s"), [], "s", [i / 100 for i in range(1, 100)]).select(F.array_sort(F.array_distinct("cuts")).alias("cuts"))
    else:
        cuts = df.sparkSession.createDataFrame([(sorted({float(x) for x in grid}),)], "cuts array<double>")
    place = rows.crossJoin(F.broadcast(cuts)).withColumn("at", F.size(F.filter("cuts", lambda c: c <= F.col("s"))))
    cells = place.groupBy("at").agg(F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("y") == 0, F.col("w")).otherwise(0.0)).alias("n"))
    marks = cuts.select(F.posexplode("cuts").alias("i", "threshold"))
    sums = marks.join(F.broadcast(cells)).groupBy("threshold").agg(*[F.sum(F.when(c, F.col(k)).otherwise(0.0)).alias(a) for a, k, c in (("tp", "p", F.col("at") > F.col("i")), ("fn", "p", F.col("at") <= F.col("i")), ("fp", "n", F.col("at") > F.col("i")), ("tn", "n", F.col("at") <= F.col("i")))])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fn, fp, tn = map(F.col, ("tp", "fn", "fp", "tn"))
    value = (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2 if metric == "balanced_accuracy" else ratio(2 * tp, 2 * tp + fp + fn)
    return sums.select("threshold", value.alias("value")).orderBy(F.desc(F.round("value", 12)), "threshold").limit(1)
