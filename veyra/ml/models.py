"""Model registry, fitted pipelines (impute, scale, select, classify) and nested, grouped cross-validation."""

from __future__ import annotations

import hashlib
import json
import logging
import math
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass
from itertools import product

from pyspark.ml import classification as C
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veyra.operators import survey
from veyra.operators.guard import Preparation, assert_disjoint, assert_no_leakage, greedy_folds

from .selectors import Selector

log = logging.getLogger(__name__)


class FourierSVM:
    """A Gaussian-kernel SVM by random Fourier features and a linear SVM: Spark has no kernel machine. gamma "scale" and
    "auto" are both 1 / (number of features), as columns are scaled."""

    def __init__(self, C: float = 1.0, gamma: str | float = "scale", features: int = 200, seed: int = 0):
        self.C, self.gamma, self.features, self.seed = C, gamma, features, seed

    def fit_columns(self, names: Sequence[str], vector: str = "features"):
        import numpy as np

        gamma = 1 / max(1, len(names)) if isinstance(self.gamma, str) else float(self.gamma)
        rng = np.random.default_rng(self.seed)
        w, b = rng.normal(0, math.sqrt(2 * gamma), (self.features, len(names))), rng.uniform(0, 2 * math.pi, self.features)

        def spread(df: DataFrame) -> DataFrame:
            x = vector_to_array(F.col(vector))
            rows = F.array(*[F.struct(F.array(*[F.lit(float(v)) for v in r]).alias("w"), F.lit(float(o)).alias("b")) for r, o in zip(w, b)])
            wave = F.transform(rows, lambda r: math.sqrt(2 / self.features) * F.cos(r["b"] + F.aggregate(F.zip_with(r["w"], x, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)))
            return df.withColumn(vector, array_to_vector(wave))

        return spread


@dataclass
class Spec:
    """make(n_rows, weight column, **parameters) gives an estimator; grid: values of each parameter."""

    make: Callable
    grid: Mapping[str, Sequence]
    balanced: bool = True
    spread: Callable | None = None


def registry(fast: bool = False, seed: int = 0) -> dict[str, Spec]:
    """Models by name, with their grids. XGBoost and LightGBM are listed where their packages for Spark can be imported."""
    def logistic(l1: float):
        return lambda n, w, C=1.0: _LR(maxIter=200, elasticNetParam=l1, regParam=1 / (C * n), standardization=False, weightCol=w)

    _LR = C.LogisticRegression

    def tree(n, w, impurity="gini", maxDepth=5, minInstancesPerNode=1):
        return C.DecisionTreeClassifier(impurity=impurity, maxDepth=maxDepth, minInstancesPerNode=minInstancesPerNode, seed=seed, weightCol=w)

    def forest(n, w, numTrees=100, maxDepth=5, minInstancesPerNode=1):
        return C.RandomForestClassifier(numTrees=numTrees, maxDepth=maxDepth, minInstancesPerNode=minInstancesPerNode, seed=seed, weightCol=w)

    def boosted(n, w, maxIter=100, stepSize=0.1, maxDepth=3):
        return C.GBTClassifier(maxIter=maxIter, stepSize=stepSize, maxDepth=maxDepth, seed=seed)

    def svc(n, w, C_=1.0, **_):
        return C.LinearSVC(maxIter=200, regParam=1 / (C_ * n), standardization=False, weightCol=w)

    def mlp(n, w, hidden=(50,), width=None):
        return C.MultilayerPerceptronClassifier(maxIter=200, layers=[width, *hidden, 2], seed=seed)

    pick = lambda full, quick: quick if fast else full
    deep = 30  # the deepest that Spark grows, where no limit is asked for
    out = {
        "LogisticRegression_L2": Spec(logistic(0.0), {"C": pick([0.01, 0.1, 1, 10], [0.1, 1])}),
        "LogisticRegression_L1": Spec(logistic(1.0), {"C": pick([0.01, 0.1, 1, 10], [0.1, 1])}),
        "DecisionTree": Spec(tree, {"impurity": pick(["gini", "entropy"], ["gini"]), "maxDepth": pick([3, 5, 10, deep], [5, 10]), "minInstancesPerNode": pick([1, 20, 50], [20])}),
        "RandomForest": Spec(forest, {"numTrees": pick([100, 300], [100]), "maxDepth": pick([5, 10, deep], [10]), "minInstancesPerNode": pick([1, 10], [10])}),
        "GradientBoosting": Spec(boosted, {"maxIter": pick([100, 200], [50]), "stepSize": pick([0.01, 0.1], [0.1]), "maxDepth": pick([2, 3], [3])}, balanced=False),
        "LinearSVC": Spec(svc, {"C_": pick([0.01, 0.1, 1], [0.1])}),
        "SVM": Spec(svc, {"C_": pick([0.1, 1, 10], [1]), "gamma": pick(["scale", "auto"], ["scale"])}, spread=lambda gamma="scale", **_: FourierSVM(gamma=gamma, seed=seed)),
        "MLP": Spec(mlp, {"hidden": pick([(100,), (50, 50)], [(50,)])}, balanced=False),
    }
    try:
        from xgboost.spark import SparkXGBClassifier
    except ImportError:
        pass
    else:
        out["XGBoost"] = Spec(lambda n, w, **p: SparkXGBClassifier(features_col="features", label_col="label", random_state=seed, **p), {"n_estimators": pick([100, 300], [100]), "learning_rate": pick([0.01, 0.1], [0.1]), "max_depth": pick([3, 6], [3])}, balanced=False)
    try:
        from synapse.ml.lightgbm import LightGBMClassifier
    except ImportError:
        pass
    else:
        out["LightGBM"] = Spec(lambda n, w, **p: LightGBMClassifier(weightCol=w, seed=seed, **p), {"numIterations": pick([100, 300], [100]), "learningRate": pick([0.01, 0.1], [0.1]), "numLeaves": pick([15, 31], [31])})
    return out


def get_models(names: Sequence[str] | None = None, fast: bool = False, seed: int = 0) -> dict[str, Spec]:
    every = registry(fast, seed)
    if unknown := [n for n in names or () if n not in every]:
        raise KeyError(f"unknown models: {unknown}; known: {sorted(every)}")
    return {n: every[n] for n in names or every}


def supports_probability(model) -> bool:
    return hasattr(model, "getProbabilityCol")


def score_matrix(model, df: DataFrame, name: str = "score") -> DataFrame:
    """Adds the probability of class 1, or the margin of models without probabilities."""
    if not (supports_probability(model) or hasattr(model, "getRawPredictionCol")):
        raise AttributeError(f"{type(model).__name__} gives neither probabilities nor margins")
    column = model.getProbabilityCol() if supports_probability(model) else model.getRawPredictionCol()
    out = model.transform(df)
    return out.withColumn(name, vector_to_array(F.col(column))[1]).drop("rawPrediction", "probability", "prediction")


class Fitted:
    """A fitted pipeline: preparation and selection learnt on the training rows only, then a classifier."""

    def __init__(self, train: DataFrame, features: Sequence[str], label: str, spec: Spec, params: Mapping, selector: Selector | None, key: str | None = None):
        self.preparation = Preparation(train, features)
        ready = self.preparation.apply(train)
        names = self.preparation.names
        self.selector = selector.fit(ready, names, label, key) if selector is not None else None
        self.names = self.selector.selected_ if self.selector else names
        self.spread = spec.spread(**params).fit_columns(self.names) if spec.spread else None
        counts = {r[0]: r[1] for r in train.groupBy(label).count().collect()}
        n = sum(counts.values())
        weight = F.lit(1.0)
        if spec.balanced:
            for y, c in counts.items():
                weight = F.when(F.col(label) == y, n / (len(counts) * c)).otherwise(weight)
        rows = self._vectors(ready.withColumn("_weight", weight)).select("features", F.col(label).cast("double").alias("label"), "_weight").cache()
        given = {**params, "width": len(self.names)} if "hidden" in spec.grid else dict(params)
        self.model = spec.make(n, "_weight", **given).fit(rows)
        rows.unpersist()

    def _vectors(self, ready: DataFrame) -> DataFrame:
        out = VectorAssembler(inputCols=self.names, outputCol="features").transform(ready.drop("features"))
        return self.spread(out) if self.spread else out

    def transformed(self, df: DataFrame) -> DataFrame:
        """All steps but the classifier: the columns that it sees, by name."""
        return self.preparation.apply(df)

    def score_ready(self, ready: DataFrame, name: str = "score") -> DataFrame:
        return score_matrix(self.model, self._vectors(ready), name).drop("features")

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """df with the score; its own columns stay as they are."""
        copies = {f: f"_own_{i}" for i, f in enumerate(self.preparation.features)}
        kept = df.withColumns({c: F.col(f"`{f}`") for f, c in copies.items()})
        out = self.score_ready(self.transformed(kept), name)
        return out.withColumns({f: F.col(c) for f, c in copies.items()}).select(*df.columns, name)


@dataclass
class NestedCV:
    outer_splits: int = 5
    outer_repeats: int = 5
    inner_splits: int = 5
    threshold_metric: str = "balanced_accuracy"
    seed: int = 0
    stratified: bool = True


def row_signature(df: DataFrame, label: str, cluster: str, columns: Sequence[str]) -> dict:
    """What tells one sample from another, whatever its order: counts, clusters, and a sum of hashes of all values."""
    got = df.agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("n_pos"), F.countDistinct(cluster).alias("n_groups"), F.sum(F.xxhash64(label, cluster, *[f"`{c}`" for c in columns]).cast("decimal(38,0)")).alias("rows")).first()
    return {k: str(v) for k, v in got.asDict().items()}


def fingerprint(cfg: NestedCV, models: Sequence[str], selector: Selector | None, features: Sequence[str], weighted: bool, sample: Mapping) -> str:
    """Ten hex digits of all that changes what a fold means."""
    chosen = None if selector is None else {"class": type(selector).__name__, "params": {k: str(v) for k, v in selector.params().items()}}
    told = {"cfg": asdict(cfg), "models": sorted(models), "selector": chosen, "features": sorted(features), "weighted": weighted, "sample": dict(sample)}
    return hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()[:10]


def fold_table(df: DataFrame, cluster: str, label: str, splits: int, seed: int, stratified: bool = True) -> DataFrame:
    """(cluster, fold): whole clusters, class shares as even as a greedy pass makes them; seed settles equal clusters."""
    return greedy_folds(df, cluster, label, splits, seed=seed, stratified=stratified)


def repeated_splits(df: DataFrame, cluster: str, label: str, splits: int, repeats: int, seed: int = 0, stratified: bool = True) -> DataFrame:
    """(repeat, cluster, fold) for seeds seed, seed + 1 and so on."""
    parts = [fold_table(df, cluster, label, splits, seed + r, stratified).withColumn("repeat", F.lit(r)) for r in range(repeats)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _grid(spec: Spec) -> list[dict]:
    return [dict(zip(spec.grid, v)) for v in product(*spec.grid.values())]


def _auc(scored: DataFrame, label: str) -> float:
    got = survey.auc(scored, [], label, "score").first()[0]
    return math.nan if got is None else got


def run_nested(df: DataFrame, features: Sequence[str], label: str, cluster: str, models: Mapping[str, Spec], cfg: NestedCV, *, selector: Callable[[], Selector | None] = lambda: None, key: str | None = None, weight: str | None = None, task: str = "", pv: int = 1, method: str = "", store=None, resume: bool = True) -> list[dict]:
    """One row for each outer fold: the best model by inner AUC, its threshold from inner scores, and metrics on the outer
    test part, which is scored once. Clusters never cross a split. store (veyra.sources.tables.FoldStore) keeps rows and
    predictions; folds it has under the same fingerprint aren't run again. Weights enter the metrics only."""
    assert_no_leakage(features, where="run_nested")
    sample = row_signature(df, label, cluster, features)
    mark = fingerprint(cfg, list(models), selector(), features, weight is not None, sample)
    done = {(r["rep"], r["fold"]): r for r in (store.rows(mark, task=task, pv=pv, method=method) if store is not None and resume else [])}
    out = []
    for rep in range(cfg.outer_repeats):
        folds = fold_table(df, cluster, label, cfg.outer_splits, cfg.seed + rep, cfg.stratified)
        placed = df.join(F.broadcast(folds), cluster)
        for fold in range(cfg.outer_splits):
            if (rep, fold) in done:
                out.append(done[rep, fold])
                continue
            began = time.perf_counter()
            train, test = placed.where(F.col("fold") != fold).drop("fold").cache(), placed.where(F.col("fold") == fold).drop("fold").cache()
            assert_disjoint(train, test, cluster)
            inner = fold_table(train, cluster, label, cfg.inner_splits, cfg.seed + rep, cfg.stratified)
            split = train.join(F.broadcast(inner.withColumnRenamed("fold", "_inner")), cluster).cache()
            parts = [(split.where(F.col("_inner") != k), split.where(F.col("_inner") == k)) for k in range(cfg.inner_splits)]

            def out_of_fold(spec, params, parts=parts):
                return [Fitted(a, features, label, spec, params, selector(), key).score(b).select(F.col(label).alias("y"), "score") for a, b in parts]

            best, inner_scores = (None, None, -math.inf, []), {}
            for name, spec in models.items():
                for params in _grid(spec):
                    try:
                        scored = out_of_fold(spec, params)
                        value = sum(_auc(s.withColumnRenamed("y", label), label) for s in scored) / len(parts)
                    except Exception as e:  # a model that can't be fitted leaves the others
                        log.error("%s %s: %s", name, params, str(e)[:200])
                        continue
                    inner_scores[name] = max(value, inner_scores.get(name, -math.inf))
                    if math.isfinite(value) and value > best[2]:
                        best = (name, params, value, scored)
            name, params, value, scored = best
            if name is None:
                log.error("no model could be fitted in repeat %d, fold %d", rep, fold)
                continue
            pooled = scored[0]  # of models fitted on the inner folds, not of the one that the outer test part meets
            for s in scored[1:]:
                pooled = pooled.unionByName(s)
            cut = survey.select_threshold(pooled, "y", F.col("score"), metric=cfg.threshold_metric).first()
            threshold = cut["threshold"] if cut else 0.5
            fitted = Fitted(train, features, label, models[name], params, selector(), key)
            kept = fitted.score(test).select(F.col(label).alias("y_true"), F.col("score").alias("y_score"), F.col(cluster).alias("group"), (F.col(weight) if weight else F.lit(None).cast("double")).alias("sample_weight")).cache()
            row = {"task": task, "pv": pv, "method": method, "rep": rep, "fold": fold, "cfg_fingerprint": mark, "best_model": name, "inner_score": value, "best_params": json.dumps({k: str(v) for k, v in params.items()}), "threshold": threshold}
            counts = train.agg(F.count("*"), F.countDistinct(cluster)).first(), test.agg(F.count("*"), F.countDistinct(cluster)).first()
            row |= {"n_train": counts[0][0], "n_test": counts[1][0], "n_schools_train": counts[0][1], "n_schools_test": counts[1][1], "n_selected": len(fitted.names), "selected": fitted.names, "inner_scores_all_models": json.dumps(inner_scores, sort_keys=True)}
            for prefix, w in [("", None)] + ([("w_", F.col("sample_weight"))] if weight else []):
                m = survey.classification_metrics(kept, [], "y_true", "y_score", threshold, w).first().asDict()
                row |= {f"{prefix}{k}": v for k, v in m.items() if k != "threshold"}
            row["fit_seconds"] = round(time.perf_counter() - began, 2)
            if store is not None:
                store.add(mark, row, kept)
            out.append(row)
            for x in (train, test, split, kept):
                x.unpersist()
    return out


def stump(df: DataFrame, feature: str, label: str) -> DataFrame:
    """threshold, accuracy, above: the best split of one feature in two (rows at or above the threshold are class above)."""
    from veyra.operators.ordered import cumulate

    cells = df.where(F.col(feature).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(feature).cast("double").alias("x")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    order = cumulate(cells, [], "x", ["p", "q"]).crossJoin(F.broadcast(cells.agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))))
    right = F.col("below_q") + F.col("sp") - F.col("below_p")
    both = order.withColumn("accuracy", F.greatest(right, F.col("sp") + F.col("sq") - right) / (F.col("sp") + F.col("sq"))).withColumn("above", (2 * right >= F.col("sp") + F.col("sq")).cast("int"))
    return both.select(F.col("x").alias("threshold"), "accuracy", "above").orderBy(F.desc(F.round("accuracy", 12)), "threshold").limit(1)


def stump_accuracy(df: DataFrame, feature: str, label: str, fold: str, folds: int) -> float:
    """Mean accuracy of the stump on folds that it wasn't fitted on: near 1 for a feature that is the outcome."""
    got = []
    for k in range(folds):
        cut = stump(df.where(F.col(fold) != k), feature, label).first()
        hit = F.when(F.col(feature) >= cut["threshold"], cut["above"]).otherwise(1 - cut["above"]) == F.col(label)
        got.append(df.where(F.col(fold) == k).agg(F.avg(hit.cast("double"))).first()[0])
    return sum(got) / len(got)
