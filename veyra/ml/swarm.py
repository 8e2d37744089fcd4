"""Feature search by particle swarms: fixed-length binary, and of variable length over a ranking.

The swarm's state is small and stays on the driver; fitness is what is spread: the particles that need a value go out as
rows, the bounded sample that they are judged on is broadcast. A mask is judged once. Unlike searches that update each
particle's memory at once, an iteration moves all particles by the memory of the one before, so that its particles can
be judged side by side.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veyra.operators import selection
from veyra.operators.resample import stratified_sample

from .selectors import Selector


def balanced_knn(x: np.ndarray, y: np.ndarray, k: int, splits: int, seed: int) -> float:
    """Mean balanced accuracy of k nearest neighbours over stratified folds."""
    fold, rng = np.empty(len(y), int), np.random.default_rng(seed)
    for c in np.unique(y):
        own = rng.permutation(np.flatnonzero(y == c))
        fold[own] = np.arange(len(own)) % splits
    scores = []
    for f in range(splits):
        a, b = x[fold != f], x[fold == f]
        ya, yb = y[fold != f], y[fold == f]
        near = min(k, max(1, len(ya) - 1))
        hit = np.empty(len(yb), int)
        for s in range(0, len(b), 512):
            d = (b[s : s + 512] ** 2).sum(1)[:, None] - 2 * b[s : s + 512] @ a.T + (a**2).sum(1)[None, :]
            nn = np.argpartition(d, near - 1, axis=1)[:, :near]
            hit[s : s + 512] = 2 * ya[nn].sum(1) > near
        scores.append(np.mean([(hit[yb == c] == c).mean() for c in np.unique(yb)]))
    return float(np.mean(scores))


class Swarm(Selector):
    """Shared: the objective gamma * balanced accuracy - length_penalty * share of features - interpretability_weight *
    mean pairwise symmetric uncertainty, to be maximised; no feature gives minus infinity."""

    def __init__(self, *, population_size: int = 60, max_iter: int = 100, inertia_start: float = 0.9, inertia_end: float = 0.4, c1: float = 1.49445, c2: float = 1.49445, gamma_accuracy: float = 0.8, length_penalty: float = 0.15, interpretability_weight: float = 0.05, k_neighbors: int = 5, fitness_cv_splits: int = 3, fitness_subsample: int = 3000, convergence_tol: float = 1e-6, convergence_patience: int = 15, n_bins: int = 10, seed: int = 0, min_features: int = 1):
        super().__init__(None, min_features=min_features)
        own = dict(locals())
        self.__dict__.update({k: v for k, v in own.items() if k not in ("self", "own", "__class__")})

    def validate(self) -> None:
        if self.fitness_cv_splits < 2:
            raise ValueError("fitness_cv_splits must be 2 at least: particles are never judged on rows they were fitted on")

    def begin(self, df: DataFrame, features: Sequence[str], label: str, key: str) -> None:
        self.validate()
        self.names_in_, self.began_ = list(features), time.perf_counter()
        binned = selection.decile_bins(selection.unpivot(df, [label], features), self.n_bins)
        scores = {r["feature"]: r[self.ranked_by] for r in selection.symmetric_uncertainty(binned, label).collect()}
        self.rank_scores_ = np.array([scores.get(f) or 0.0 for f in features])
        self.ranking_ = np.argsort(-self.rank_scores_, kind="stable")
        place = {f: i for i, f in enumerate(features)}
        self.pairs_ = np.zeros((len(features), len(features)))
        if self.interpretability_weight:
            for r in selection.su_matrix(df, features, self.n_bins).collect():
                self.pairs_[place[r["a"]], place[r["b"]]] = r["su"] or 0.0
        sample = stratified_sample(df.select(key, label, *[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)).alias(f) for f in features]), label, key, self.fitness_subsample, self.seed)
        rows = sample.orderBy(key).collect()
        x, y = np.array([[r[f] for f in features] for r in rows], dtype=np.float32), np.array([r[label] for r in rows], dtype=int)
        self.splits_ = int(max(2, min(self.fitness_cv_splits, np.bincount(y).min())))
        self.spark_, self.sample_ = df.sparkSession, df.sparkSession.sparkContext.broadcast((x, y))
        self.known_: dict[bytes, float] = {}
        self.n_evaluations_ = 0

    ranked_by = "su"

    def fitness(self, masks: Sequence[np.ndarray]) -> np.ndarray:
        """Values of all masks; new ones are judged in one job."""
        self.n_evaluations_ += len(masks)
        new = list({m.tobytes(): m for m in masks if m.any() and m.tobytes() not in self.known_}.values())
        if new:
            sent, k, splits, seed = self.sample_, self.k_neighbors, self.splits_, self.seed

            def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                x, y = sent.value
                for f in frames:
                    cols = [np.flatnonzero(np.frombuffer(m, bool)) for m in f["mask"]]
                    yield pd.DataFrame({"i": f["i"], "v": [balanced_knn(x[:, c], y, k, splits, seed) for c in cols]})

            rows = self.spark_.createDataFrame([(i, bytearray(m.tobytes())) for i, m in enumerate(new)], "i int, mask binary")
            for r in rows.repartition(min(len(new), self.spark_.sparkContext.defaultParallelism)).mapInPandas(judge, "i int, v double").collect():
                m = new[r["i"]]
                on = np.flatnonzero(m)
                extra = self.pairs_[np.ix_(on, on)][np.triu_indices(len(on), 1)].mean() if len(on) > 1 else 0.0
                self.known_[m.tobytes()] = self.gamma_accuracy * r["v"] - self.length_penalty * len(on) / len(m) - self.interpretability_weight * extra
        return np.array([self.known_[m.tobytes()] if m.any() else -np.inf for m in masks])

    def inertia(self, it: int) -> float:
        return self.inertia_start - (self.inertia_start - self.inertia_end) * it / max(1, self.max_iter - 1)

    def trace(self, it: int, fits: np.ndarray, sizes: Sequence[int], lengths: Sequence[int]) -> None:
        self.convergence_.append({"iteration": it, "best_fitness": float(self.best_[0]), "mean_fitness": float(np.mean(fits)), "mean_length": float(np.mean(lengths)), "mean_selected": float(np.mean(sizes)), "n_evaluations": self.n_evaluations_})

    def search(self, step, fits: np.ndarray, current) -> None:
        """Runs step(iteration) until max_iter, or until the best hasn't risen for convergence_patience iterations."""
        self.convergence_, still = [], 0
        i = int(np.argmax(fits))
        self.best_ = (fits[i], *current(i))
        self.stopped_early_, self.stop_iteration_ = False, self.max_iter - 1
        for it in range(self.max_iter):
            fits, sizes, lengths = step(it)
            i = int(np.argmax(fits))
            if fits[i] > self.best_[0] + self.convergence_tol:
                self.best_, still = (fits[i], *current(i)), 0
            else:
                still += 1
            self.trace(it, fits, sizes, lengths)
            if still >= self.convergence_patience:
                self.stopped_early_, self.stop_iteration_ = True, it
                break

    def end(self, mask: np.ndarray) -> Swarm:
        self.finish([self.names_in_[i] for i in np.flatnonzero(mask)], dict(zip(self.names_in_, self.rank_scores_.tolist())))
        self.gbest_fitness_, self.fit_seconds_ = float(self.best_[0]), time.perf_counter() - self.began_
        return self

    def algorithm_report(self) -> dict:
        """Settings and, after fit(), what the run did."""
        done = {k.rstrip("_"): getattr(self, k) for k in ("stopped_early_", "stop_iteration_", "n_evaluations_", "fit_seconds_", "gbest_fitness_", "gbest_length_") if hasattr(self, k)}
        return {"algorithm": type(self).__name__, "direction": "maximise", "objective": "gamma * balanced accuracy - lambda * share of features - mu * redundancy", "inertia": f"{self.inertia_start} to {self.inertia_end}", **self.params(), **done, "n_selected": len(self.selected_) if hasattr(self, "selected_") else None}

    def complexity(self) -> str:
        return "iterations * particles * folds * n^2 * |S| for nearest neighbours on n sampled rows, once for each distinct mask; ranking is n * p, pairwise uncertainty n * p^2"

    def convergence_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(pd.DataFrame(self.convergence_))


class BinarySwarm(Swarm):
    """Binary positions by a sigmoid of the velocity; at most max_cardinality features, those ranked best."""

    def __init__(self, *, max_cardinality: int | None = None, **settings):
        super().__init__(**settings)
        self.max_cardinality = max_cardinality

    def capped(self, bits: np.ndarray) -> np.ndarray:
        on = np.flatnonzero(bits)
        if self.max_cardinality is None or len(on) <= self.max_cardinality:
            return bits
        out = np.zeros_like(bits)
        out[on[np.argsort(-self.rank_scores_[on], kind="stable")[: self.max_cardinality]]] = True
        return out

    def fit(self, df: DataFrame, features: Sequence[str], label: str, key: str | None = None) -> BinarySwarm:
        from veyra.operators.guard import assert_no_leakage

        assert_no_leakage(features, where="BinarySwarm.fit")
        self.begin(df, features, label, key)
        rng, shape = np.random.default_rng(self.seed), (self.population_size, len(features))
        self.position_ = np.array([self.capped(b) for b in rng.random(shape) < 0.5])
        self.velocity_ = rng.normal(0, 1, shape)
        memory, value = self.position_.copy(), self.fitness(list(self.position_))

        def step(it: int):
            r1, r2 = rng.random(shape), rng.random(shape)
            pull = self.c1 * r1 * (memory.astype(float) - self.position_) + self.c2 * r2 * (self.best_[1].astype(float) - self.position_)
            self.velocity_ = np.clip(self.inertia(it) * self.velocity_ + pull, -6, 6)
            chance = 1 / (1 + np.exp(-np.clip(self.velocity_, -10, 10)))
            self.position_ = np.array([self.capped(b) for b in rng.random(shape) < chance])
            fits = self.fitness(list(self.position_))
            up = fits > value + self.convergence_tol
            memory[up], value[up] = self.position_[up], fits[up]
            return value, self.position_.sum(1), [shape[1]] * shape[0]

        self.search(step, value, lambda i: (memory[i].copy(),))
        return self.end(self.best_[1])


class VariableLengthSwarm(Swarm):
    """Particles of own lengths: place d stands for the feature ranked d-th, chosen where the position is above the
    selection threshold. A particle that stagnates grows or shrinks."""

    def __init__(self, *, divisions: int = 12, beta_stagnation: int = 9, min_length: int = 2, max_length: int | None = None, growth_prob: float = 0.5, length_step: int = 1, length_direction: str = "both", exemplar_fallback: str = "gbest_longest", init: str = "ranked", ranking: str = "symmetric_uncertainty", selection_threshold: float = 0.5, **settings):
        super().__init__(**{"min_features": min_length} | settings)
        own = dict(locals())
        self.__dict__.update({k: v for k, v in own.items() if k not in ("self", "own", "settings", "__class__")})
        self.ranked_by = "mi" if ranking == "mutual_info" else "su"

    def validate(self) -> None:
        super().validate()
        for name, known in (("length_direction", ("both", "shrink_only", "grow_only")), ("ranking", ("symmetric_uncertainty", "mutual_info")), ("init", ("ranked", "random")), ("exemplar_fallback", ("gbest_longest", "pbest", "inertia"))):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} must be one of {known}, not {getattr(self, name)!r}")
        if self.beta_stagnation >= self.max_iter:
            raise ValueError(f"beta_stagnation {self.beta_stagnation} never comes within max_iter {self.max_iter}: lengths would stay")

    def mask(self, position: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.names_in_), bool)
        out[self.ranking_[: len(position)][position > self.selection_threshold]] = True
        return out

    def start(self, rng) -> list[dict]:
        low, high = self.min_length, self.longest_
        step = max(1, (high - low) // max(1, self.divisions))
        swarm = []
        for i in range(self.population_size):
            n = int(np.clip(low + (i % self.divisions) * step + rng.integers(0, step), low, high))
            at = np.clip(np.linspace(0.85, 0.35, n) + rng.normal(0, 0.15, n), 0, 1) if self.init == "ranked" else rng.random(n)
            swarm.append({"at": at, "v": rng.normal(0, 0.1, n), "memory": at.copy(), "value": -np.inf, "idle": 0})
        return swarm

    def exemplar(self, swarm: list[dict], p: dict, d: int) -> float:
        """What to learn from at a place that the best particle lacks; NaN: nothing."""
        own = p["memory"][d] if d < len(p["memory"]) else np.nan
        if self.exemplar_fallback == "inertia":
            return np.nan
        if self.exemplar_fallback == "gbest_longest":
            longer = [q for q in swarm if len(q["memory"]) > d and q["value"] > -np.inf]
            if longer:
                return max(longer, key=lambda q: q["value"])["memory"][d]
        return own

    def grow(self, p: dict, swarm: list[dict], rng) -> None:
        """New places start where the best particle that has them stands, at rest."""
        for d in range(len(p["at"]), min(len(p["at"]) + self.length_step, self.longest_)):
            donors = [q for q in swarm if len(q["at"]) > d]
            seed = max(donors, key=lambda q: q["value"])["at"][d] if donors else rng.random()
            p["at"], p["v"] = np.append(p["at"], seed), np.append(p["v"], 0.0)
            if len(p["memory"]) <= d:
                p["memory"] = np.append(p["memory"], seed)

    def shrink(self, p: dict) -> None:
        n = max(len(p["at"]) - self.length_step, self.min_length)
        p["at"], p["v"] = p["at"][:n], p["v"][:n]

    def adapt(self, p: dict, swarm: list[dict], rng) -> None:
        if self.length_direction == "grow_only" or self.length_direction == "both" and rng.random() < self.growth_prob:
            self.grow(p, swarm, rng)
        else:
            self.shrink(p)

    def move(self, swarm: list[dict], p: dict, it: int, rng) -> None:
        n, best = len(p["at"]), self.best_[1]
        r1, r2 = rng.random(n), rng.random(n)
        social = np.array([best[d] if d < len(best) else self.exemplar(swarm, p, d) for d in range(n)])
        memory = np.array([p["memory"][d] if d < len(p["memory"]) else np.nan for d in range(n)])
        pull = np.nan_to_num(self.c1 * r1 * (memory - p["at"])) + np.nan_to_num(self.c2 * r2 * (social - p["at"]))
        p["v"] = np.clip(self.inertia(it) * p["v"] + pull, -0.5, 0.5)
        p["at"] = np.clip(p["at"] + p["v"], 0, 1)

    def fit(self, df: DataFrame, features: Sequence[str], label: str, key: str | None = None) -> VariableLengthSwarm:
        from veyra.operators.guard import assert_no_leakage

        assert_no_leakage(features, where="VariableLengthSwarm.fit")
        self.begin(df, features, label, key)
        rng = np.random.default_rng(self.seed)
        self.longest_ = int(np.clip(self.max_length or len(features), min(self.min_length + 1, len(features)), len(features)))
        swarm = self.start(rng)
        for p, v in zip(swarm, self.fitness([self.mask(p["at"]) for p in swarm])):
            p["value"] = v
        self.length_history_ = []

        def step(it: int):
            for p in swarm:
                self.move(swarm, p, it, rng)
            for p, v in zip(swarm, self.fitness([self.mask(p["at"]) for p in swarm])):
                if v > p["value"] + self.convergence_tol:
                    p["value"], p["memory"], p["idle"] = v, p["at"].copy(), 0
                else:
                    p["idle"] += 1
            for p in swarm:
                if p["idle"] >= self.beta_stagnation:
                    self.adapt(p, swarm, rng)
                    p["idle"] = 0
            lengths = [len(p["at"]) for p in swarm]
            self.length_history_.append(lengths)
            return np.array([p["value"] for p in swarm]), [int(self.mask(p["at"]).sum()) for p in swarm], lengths

        self.search(step, np.array([p["value"] for p in swarm]), lambda i: (swarm[i]["memory"].copy(),))
        self.gbest_length_, self.final_lengths_ = len(self.best_[1]), [len(p["at"]) for p in swarm]
        return self.end(self.mask(self.best_[1]))
