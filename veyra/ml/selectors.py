"""Feature selectors: each scores all features of a table and keeps some of them by name."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veyra.operators import neighbours, selection
from veyra.operators.guard import assert_no_leakage

log = logging.getLogger(__name__)
FLAG = "missingindicator_"


class Selector:
    """fit() keeps names_in, scores (by name) and selected, in the order of names_in."""

    scored = True

    def __init__(self, k: int | None = None, *, min_features: int = 1):
        self.k, self.min_features = k, min_features

    def params(self) -> dict:
        return {n: v for n, v in sorted(vars(self).items()) if not n.endswith("_")}

    def score(self, df: DataFrame, features: Sequence[str], label: str, key: str) -> DataFrame:
        """(feature, score), to be given by each selector."""
        raise NotImplementedError

    def choose(self, scores: dict[str, float]) -> list[str]:
        order = sorted(scores, key=lambda f: (-scores[f], self.names_in_.index(f)))
        return order[: min(self.k or len(order), len(order))]

    def fit(self, df: DataFrame, features: Sequence[str], label: str, key: str | None = None) -> Selector:
        assert_no_leakage(features, where=f"{type(self).__name__}.fit")
        self.names_in_ = list(features)
        got = {r[0]: r[1] for r in self.score(df, features, label, key).collect()} if self.scored else {f: 1.0 for f in features}
        known = {f: (s if (s := got.get(f)) is not None and s == s else float("-inf")) for f in features}
        return self.finish(self.choose(known), known)

    def finish(self, chosen: Sequence[str], scores: dict[str, float]) -> Selector:
        """Fewer than min_features chosen: the best of all by score."""
        if len(chosen) < self.min_features:
            log.warning("%s chose %d features; taking the %d best", type(self).__name__, len(chosen), self.min_features)
            chosen = sorted(scores, key=lambda f: (-scores[f], self.names_in_.index(f)))[: self.min_features]
        self.scores_, self.selected_ = scores, [f for f in self.names_in_ if f in set(chosen)]
        return self

    @property
    def selected_items(self) -> list[str]:
        return [f for f in self.selected_ if not f.startswith(FLAG)]

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return df.select(*keep, *[F.col(f"`{f}`") for f in self.selected_])

    def report(self) -> dict:
        return {"selector": type(self).__name__, "n_in": len(self.names_in_), "n_selected": len(self.selected_), "selected": self.selected_, "n_items": len(self.selected_items), "selected_items": self.selected_items}


class Identity(Selector):
    scored = False


class SymmetricUncertainty(Selector):
    def score(self, df, features, label, key):
        return selection.symmetric_uncertainty(selection.decile_bins(selection.unpivot(df, [label], features)), label).select("feature", F.col("su").alias("score"))


class MutualInformation(Selector):
    """By binned mutual information: the plug-in value, where others estimate it from neighbours with random jitter."""

    def score(self, df, features, label, key):
        return selection.symmetric_uncertainty(selection.decile_bins(selection.unpivot(df, [label], features)), label).select("feature", F.col("mi").alias("score"))


class ChiSquared(Selector):
    def score(self, df, features, label, key):
        return selection.chi2(selection.unpivot(df, [label], features), label).select("feature", F.col("chi2").alias("score"))


class ReliefF(Selector):
    def __init__(self, k: int = 10, *, min_features: int = 1, neighbours: int = 10, samples: int = 500, seed: int = 0):
        super().__init__(k, min_features=min_features)
        self.neighbours, self.samples, self.seed = neighbours, samples, seed

    def score(self, df, features, label, key):
        if key is None:
            raise ValueError("ReliefF needs a column that tells rows apart")
        return neighbours.relief_f(df, features, label, key, k=self.neighbours, samples=self.samples, seed=self.seed)
