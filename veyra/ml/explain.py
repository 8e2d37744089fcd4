"""Explanations of fitted models as DataFrame plans: Shapley values, local surrogates, agreement, permutation importance.

A model is a function from a table in its feature space to the same table with a score. Perturbed rows are rows of a
table, so any Spark model scores them where they lie; numbers are drawn by hashes, so lost tasks draw them again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veyra.operators.guard import permute_within, places, spearman
from veyra.operators.kept import kept
from veyra.operators.ordered import counted, dealt, mixed, quantiles
from veyra.operators.resample import stratified_sample
from veyra.operators.survey import auc

Model = Callable[[DataFrame], DataFrame]

CAUSAL_CAVEAT = "These values describe how a fitted model uses its inputs on observational data. They don't show that an input causes the outcome, nor that changing it would change the outcome; an order of inputs by size is no order in time."


@dataclass
class ExplainerSpec:
    """How values were made."""

    model_name: str
    explainer: str
    background_source: str
    background_size: int
    background_method: str
    output_scale: str
    feature_perturbation: str
    n_samples: int | None
    seed: int
    n_explained: int
    version: str = "veyra"

    def row(self) -> dict:
        return asdict(self)


def background(train: DataFrame, features: Sequence[str], key: str, size: int = 200, method: str = "kmeans", seed: int = 0) -> DataFrame:
    """(weight, features) of at most size rows that stand for the training rows: cluster centres with their shares, or rows
    by hash."""
    if method == "random":
        rows = dealt(train.select(key, *features), [], F.col(key), seed, "_i").where(F.col("_i") < size)
        return rows.select(F.lit(1.0).alias("weight"), *features)
    if method != "kmeans":
        raise ValueError(f"unknown method {method!r}")
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(train.select(*features))
    model = KMeans(k=max(2, min(size, train.count())), seed=seed, maxIter=10).fit(rows)
    centres, sizes = model.clusterCenters(), model.summary.clusterSizes
    return train.sparkSession.createDataFrame([(float(n), *map(float, c)) for c, n in zip(centres, sizes) if n], ["weight", *features])


def check_space(fitted, names: Sequence[str], wanted: Sequence[str] | None = None) -> None:
    """Refuses whole pipelines, and tables that aren't in the model's feature space."""
    if hasattr(fitted, "preparation") or hasattr(fitted, "stages"):
        raise TypeError("give the bare model and tables in its feature space, not a pipeline")
    expected = getattr(fitted, "numFeatures", None)
    if expected not in (None, len(names)) or wanted is not None and list(wanted) != list(names):
        raise ValueError(f"the model was fitted on {expected if wanted is None else list(wanted)}, not {list(names)}")


def linear_shap(rows: DataFrame, coefficients: dict[str, float], centre: DataFrame, key: str) -> DataFrame:
    """(instance, feature, shap_value, feature_value, abs_shap) of a linear model, exact: the coefficient times the distance
    from the background's weighted mean; one projection."""
    means = centre.agg(*[(F.sum(F.col(f"`{f}`") * F.col("weight")) / F.sum("weight")).alias(f) for f in coefficients]).first()
    parts = [F.struct(F.lit(f).alias("feature"), (F.lit(float(b)) * (F.col(f"`{f}`") - F.lit(means[f]))).alias("shap_value"), F.col(f"`{f}`").cast("double").alias("feature_value")) for f, b in coefficients.items()]
    long = rows.select(F.col(key).alias("instance"), F.explode(F.array(*parts)).alias("x")).select("instance", "x.*")
    return long.withColumn("abs_shap", F.abs("shap_value"))


def sampled_shap(rows: DataFrame, model: Model, centre: DataFrame, features: Sequence[str], key: str, *, permutations: int = 16, seed: int = 0) -> DataFrame:
    """Interventional Shapley values by sampled orders, for any model: along each order a background row turns into the
    explained row, feature by feature, and each step's change of the score goes to its feature. Values of a row sum to the
    mean difference of its score from the background rows'. What is scored is (features + 1) * permutations rows for each."""
    total = centre.agg(F.sum("weight")).first()[0]
    base = dealt(centre.select("weight", F.array(*[F.col(f"`{f}`").cast("double") for f in features]).alias("b")).withColumn("_id", F.xxhash64("b")), [], F.col("_id"), seed, "_i")
    upto = F.sum("weight").over(Window.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))  # at most the background's size
    base = base.select("b", (upto / total).alias("hi"), ((upto - F.col("weight")) / total).alias("lo"))
    wide = rows.select(F.col(key).alias("instance"), F.array(*[F.col(f"`{f}`").cast("double") for f in features]).alias("x"))
    runs = wide.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    runs = runs.withColumn("u", mixed(seed, F.col("instance"), F.col("run")) / F.lit(float(1 << 60)))
    runs = runs.join(F.broadcast(base), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    keys = F.array(*[F.struct(mixed(seed + 1 + i, F.col("instance"), F.col("run")).alias("r"), F.lit(i).alias("i")) for i in range(len(features))])
    order = F.transform(F.array_sort(keys), lambda s: s["i"])  # features in the order of their turn
    steps = runs.withColumn("order", order).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))
    turned = F.slice("order", 1, F.col("step"))
    point = [F.when(F.array_contains(turned, i), F.col("x")[i]).otherwise(F.col("b")[i]).alias(f) for i, f in enumerate(features)]
    scored = model(steps.select("instance", "run", "step", "order", "x", *point)).select("instance", "run", "step", "order", "x", "score")
    change = F.col("score") - F.lag("score").over(Window.partitionBy("instance", "run").orderBy("step"))
    each = scored.withColumn("d", change).where("step > 0").withColumn("f", F.element_at("order", F.col("step")))
    names = F.array(*map(F.lit, features))
    out = each.groupBy("instance", F.col("f")).agg(F.avg("d").alias("shap_value"), F.first("x").alias("x"))
    return out.select("instance", names[F.col("f")].alias("feature"), "shap_value", F.col("x")[F.col("f")].alias("feature_value"), F.abs("shap_value").alias("abs_shap"))


def importance(attributions: DataFrame, *, n_bootstrap: int = 1000, seed: int = 0) -> DataFrame:
    """(feature, mean_abs_shap, ci_low, ci_high, mean_signed_shap, rank): means over instances, with percentiles of a
    bootstrap of instances. One group for each feature, with one number for each explained instance."""
    def spread(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            v = np.asarray(v, dtype=float)
            rng = np.random.default_rng(seed)
            means = [v[rng.integers(0, len(v), len(v))].mean() for _ in range(n_bootstrap)]
            out.append([float(x) for x in np.quantile(means, [0.025, 0.975])])
        return pd.Series(out)

    got = attributions.groupBy("feature").agg(F.avg("abs_shap").alias("mean_abs_shap"), F.avg("shap_value").alias("mean_signed_shap"), F.array_sort(F.collect_list("abs_shap")).alias("_v"))
    got = got.withColumn("_ci", F.pandas_udf(spread, "array<double>")("_v"))
    ranked = got.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs_shap"), "feature")))  # one row a feature
    return ranked.select("feature", "mean_abs_shap", F.col("_ci")[0].alias("ci_low"), F.col("_ci")[1].alias("ci_high"), "mean_signed_shap", "rank")


def global_shap(model: Model, train: DataFrame, test: DataFrame, features: Sequence[str], label: str, key: str, *, model_name: str = "model", n_instances: int = 1000, background_size: int = 200, background_method: str = "kmeans", permutations: int = 16, n_bootstrap: int = 1000, seed: int = 0, coefficients: dict[str, float] | None = None) -> dict:
    """importance, spec, attributions of a stratified sample of test rows against a background of training rows. With
    coefficients, exact values of a linear model."""
    check_space(model, features, coefficients)
    rows = stratified_sample(test.select(key, label, *features), label, key, n_instances, seed).cache()
    centre = background(train, features, key, background_size, background_method, seed)
    values = linear_shap(rows, coefficients, centre, key) if coefficients else sampled_shap(rows, model, centre, features, key, permutations=permutations, seed=seed)
    spec = ExplainerSpec(model_name, "linear" if coefficients else "sampled orders", "train", centre.count(), background_method, "score", "interventional", None if coefficients else permutations, seed, rows.count())
    return {"importance": importance(values, n_bootstrap=n_bootstrap, seed=seed), "spec": spec, "attributions": values}


def top_contributors(attributions: DataFrame, instance, k: int = 8, labels: DataFrame | None = None) -> DataFrame:
    """The k largest values of one instance; labels (item, label) adds what features are called."""
    top = attributions.where(F.col("instance") == instance).orderBy(F.desc("abs_shap"), "feature").limit(k)
    if labels is not None:
        top = top.join(F.broadcast(labels.select(F.col("item").alias("feature"), "label")), "feature", "left").withColumn("label", F.coalesce("label", "feature")).orderBy(F.desc("abs_shap"), "feature")
    return top.drop("abs_shap")


def noise_benchmark(importances: DataFrame, noise: str = "noise_control") -> DataFrame:
    """available, noise_rank, n_features, noise_mean_abs_shap, n_features_below_noise, features_below_noise: what can't be
    told from injected noise. One row."""
    own = importances.where(F.col("feature") == noise).select(F.col("rank").alias("noise_rank"), F.col("mean_abs_shap").alias("noise_mean_abs_shap"))
    joined = importances.join(F.broadcast(own), how="left")
    below = F.col("rank") > F.col("noise_rank")
    got = joined.agg(F.max("noise_rank").alias("noise_rank"), F.count("*").alias("n_features"), F.max("noise_mean_abs_shap").alias("noise_mean_abs_shap"), F.count_if(below).alias("n_features_below_noise"), F.array_sort(F.collect_set(F.when(below, F.col("feature")))).alias("_b"))
    return got.select(F.col("noise_rank").isNotNull().alias("available"), "noise_rank", "n_features", "noise_mean_abs_shap", "n_features_below_noise", F.array_join("_b", ", ").alias("features_below_noise"))


def permutation_importance(model: Model, rows: DataFrame, features: Sequence[str], label: str, key: str, *, repeats: int = 10, seed: int = 0) -> DataFrame:
    """(feature, perm_importance, perm_sd): how far AUC falls when a feature's values are dealt anew. The order
    of rows that all repeats start from, and each repeat's scores while AUC is taken, are kept on disk."""
    drops = []
    with kept(places(rows.select(key, label, *features), [], key), "places") as placed:
        whole = auc(model(placed.drop("_i")), [], label, "score").first()[0]
        for i, f in enumerate(features):
            for r in range(repeats):
                permuted = permute_within(placed, [], f, key, seed + i * repeats + r, placed)
                with kept(model(permuted).select(label, "score"), "scores") as scored:
                    drops.append((f, float(whole - auc(scored, [], label, "score").first()[0])))
    long = rows.sparkSession.createDataFrame(drops, "feature string, drop double")
    return long.groupBy("feature").agg(F.avg("drop").alias("perm_importance"), F.stddev_pop("drop").alias("perm_sd"))


def local_surrogates(rows: DataFrame, model: Model, train: DataFrame, features: Sequence[str], key: str, *, n_repeats: int = 30, n_samples: int = 5000, n_features: int = 15, seed: int = 0) -> DataFrame:
    """(instance, repeat, feature, weight): for each instance and repeat, a ridge on whether each feature of a sampled row
    lies in the instance's quartile, rows weighted by how many do; the n_features largest weights stay, others are 0.
    Sampled values come from the training rows' own distribution, feature by feature. A group is n_samples rows."""
    p = len(features)
    cells = counted(train.unpivot([], [F.col(f"`{f}`").cast("double").alias(f) for f in features], "feature", "value"), ["feature"], "value")
    grid = [i / 100 for i in range(101)]
    cuts = {r["feature"]: r["cuts"] for r in quantiles(cells, ["feature"], "value", grid).collect()}
    steps = F.array(*[F.array(*[F.lit(float(v)) for v in cuts[f]]) for f in features])
    quarters = F.array(*[F.array(*[F.lit(float(cuts[f][i])) for i in (25, 50, 75)]) for f in features])

    def quarter(v, i):
        return F.size(F.filter(quarters[i], lambda c: c < v))

    wide = rows.select(F.col(key).alias("instance"), F.array(*[F.col(f"`{f}`").cast("double") for f in features]).alias("x"))
    draws = wide.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1)))).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))

    def drawn(i: int):
        at = F.xxhash64(F.lit(seed + i), "instance", "repeat", "s")
        low = F.pmod(at, F.lit(100)).cast("int")
        part = F.pmod(F.shiftright(at, 20), F.lit(1000)) / 1000.0
        sampled = steps[i][low] + part * (steps[i][low + 1] - steps[i][low])
        return F.when(F.col("s") == 0, F.col("x")[i]).otherwise(sampled).alias(features[i])

    points = draws.select("instance", "repeat", "x", *[drawn(i) for i in range(p)])
    same = F.array(*[(quarter(F.col(f"`{f}`"), i) == quarter(F.col("x")[i], i)).cast("double") for i, f in enumerate(features)])
    scored = model(points).select("instance", "repeat", same.alias("z"), "score")
    width2 = (0.75 * p**0.5) ** 2

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        z, y = np.array(g["z"].tolist()), g["score"].to_numpy()
        w = np.sqrt(np.exp(-(p - z.sum(1)) / width2))
        zm, ym = np.average(z, axis=0, weights=w), np.average(y, weights=w)
        a = (z - zm) * w[:, None]
        beta = np.linalg.solve(a.T @ (z - zm) + np.eye(p), a.T @ (y - ym))
        keep = np.argsort(-np.abs(beta), kind="stable")[:n_features]
        out = np.zeros(p)
        out[keep] = beta[keep]
        return pd.DataFrame({"instance": g["instance"].iloc[0], "repeat": g["repeat"].iloc[0], "feature": list(features), "weight": out})

    kind = rows.schema[key].dataType.simpleString()
    return scored.groupBy("instance", "repeat").applyInPandas(fit, f"instance {kind}, repeat int, feature string, weight double")


def surrogate_stability(weights: DataFrame, first: int = 10) -> tuple[DataFrame, DataFrame]:
    """(instance, feature, weight_mean, weight_sd, cv), and for each instance n_repeats, mean and least rank correlation of
    pairs among the first repeats, and the mean SD."""
    each = weights.groupBy("instance", "feature").agg(F.avg("weight").alias("weight_mean"), F.stddev_samp("weight").alias("weight_sd")).withColumn("cv", F.abs(F.try_divide(F.col("weight_sd"), F.col("weight_mean"))))
    few = weights.where(F.col("repeat") < first)
    a, b = few.withColumnsRenamed({"repeat": "ra", "weight": "wa"}), few.withColumnsRenamed({"repeat": "rb", "weight": "wb"})
    pairs = a.join(b, ["instance", "feature"]).where("ra < rb")
    rho = spearman(pairs, ["instance", "ra", "rb"], "wa", "wb").groupBy("instance").agg(F.avg(F.nanvl("rho", F.lit(None).cast("double"))).alias("mean_rank_correlation"), F.min(F.nanvl("rho", F.lit(None).cast("double"))).alias("min_rank_correlation"))
    n = weights.groupBy("instance").agg(F.countDistinct("repeat").alias("n_repeats"))
    sd = each.groupBy("instance").agg(F.avg("weight_sd").alias("mean_weight_sd"))
    return each, n.join(rho, "instance", "left").join(sd, "instance")


def rank_agreement(shap: DataFrame, surrogate: DataFrame, top_k: int = 10) -> DataFrame:
    """One row: spearman_rho of the two importances over shared features (NULL below three), n_features, top_k, overlap and
    Jaccard index of the top_k of each. shap: feature, mean_abs_shap; surrogate: feature, weight_mean."""
    mean = surrogate.groupBy("feature").agg(F.avg(F.abs("weight_mean")).alias("abs_w"))
    both = shap.select("feature", "mean_abs_shap").join(mean, "feature")
    n = both.agg(F.count("*").alias("n_features"))
    tops = [df.orderBy(F.desc(c), "feature").limit(top_k).agg(F.collect_set("feature").alias(name)) for df, c, name in ((shap, "mean_abs_shap", "_a"), (mean, "abs_w", "_b"))]
    out = n.join(spearman(both, [], "mean_abs_shap", "abs_w"), how="left").crossJoin(tops[0]).crossJoin(tops[1])
    overlap = F.size(F.array_intersect("_a", "_b"))
    return out.select(F.when(F.col("n_features") >= 3, F.col("rho")).alias("spearman_rho"), "n_features", F.lit(top_k).alias("top_k"), overlap.alias("top_k_overlap"), F.try_divide(overlap.cast("double"), F.size(F.array_union("_a", "_b")).cast("double")).alias("top_k_jaccard"))


def permutation_agreement(shap: DataFrame, permutation: DataFrame) -> DataFrame:
    """One row: spearman_rho of mean_abs_shap with perm_importance over shared features, and n_features."""
    both = shap.select("feature", "mean_abs_shap").join(permutation.select("feature", "perm_importance"), "feature")
    return both.agg(F.count("*").alias("n_features")).join(spearman(both, [], "mean_abs_shap", "perm_importance").withColumnRenamed("rho", "spearman_rho"), how="left")
