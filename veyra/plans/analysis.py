"""A survey analysis from the raw table to its reports, in stages: ingest, audit, sample, nested, assets.

    python -m veyra.plans.analysis --config settings.yaml --stages ingest,audit,sample

Each stage reads what the one before has written, or makes it; the extract is written once. Settings name the columns:
see SETTINGS. Stages return DataFrames; the runner writes them below the results folder.
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veyra.ml import models, selectors
from veyra.operators import guard as G
from veyra.operators import survey as V
from veyra.sources import manifest, tables
from veyra.sources.config import Config, environment_report, set_global_seeds

log = logging.getLogger(__name__)
STAGES = ("ingest", "audit", "sample", "nested", "assets")
#: What settings may say, and what holds where they don't.
SETTINGS = {
    "data": {"source": "", "country": "CNT", "primary": "", "external": [], "cluster": "CNTSCHID", "stratum": "STRATUM", "weight": "W_FSTUWT", "replicates": "W_FSTURWT{i}", "n_replicates": 80, "fay_k": 0.5, "missing": 400, "sensitivity": [200, 600]},
    "outcome": {"template": "PV{i}MATH", "n": 10, "cuts": [482.38, 606.99], "labels": ["Low", "Medium", "High"], "tasks": [["Low", "High"], ["Low", "Medium"], ["Medium", "High"]]},
    "cv": {"outer_splits": 5, "outer_repeats": 5, "inner_splits": 5, "models": None, "fast": False, "pvs": [1], "selector": None, "k": 15, "key": None, "ceiling": 0.95},
    "predictors": {},
}


class Analysis:
    def __init__(self, spark: SparkSession, cfg: Config):
        self.spark, self.cfg = spark, cfg
        self.set = {s: {**d, **(cfg.values.get(s) or {})} for s, d in SETTINGS.items()}
        self.data, self.outcome, self.cv = self.set["data"], self.set["outcome"], self.set["cv"]
        self.allowed = G.Allowlist(self.set["predictors"])
        set_global_seeds(cfg.seed)

    def ingest(self, force: bool = False) -> DataFrame:
        """The extract of the countries with the number of missing values in each row."""
        d = self.data
        make = lambda: tables.analytic_frame(tables.read_table(self.spark, tables.require(self.spark, d["source"])), d["country"], [d["primary"], *d["external"]])
        return tables.read_through(self.spark, f"{self.cfg.paths.interim}/analytic", make, force)

    def audit(self) -> dict[str, DataFrame]:
        """Every column's class, how many rows other cuts move, and how well one split on the mean score finds the classes:
        a table of its own, which nothing later reads."""
        df, o = self.ingest(), self.outcome
        names = self.spark.createDataFrame([(c,) for c in df.columns], "name string")
        scores = [F.col(o["template"].format(i=i)) for i in range(1, o["n"] + 1)]
        mean = sum(scores[1:], scores[0]) / len(scores)
        own, old = V.categorize(mean, o["cuts"], o["labels"]), V.legacy_category(scores, [round(c) for c in o["cuts"]], o["labels"])
        moved = df.agg(F.count("*").alias("n"), F.count_if(own != old).alias("moved"))
        rows = df.select(mean.alias("score"), own.alias("category"))
        cuts = []
        for low, high in o["tasks"]:
            got = models.stump(V.task_rows(rows, "category", low, high), "score", "y").first()
            cuts.append((f"{low}-{high}", got["accuracy"] if got else None))
        return {"column_classification": G.classify_columns(names, "name"), "reclassified": moved, "stump_accuracy": self.spark.createDataFrame(cuts, "task string, accuracy double")}

    def rows(self) -> DataFrame:
        """The primary country's rows with few enough missing values, with their categories."""
        d, o = self.data, self.outcome
        kept = self.ingest().where((F.col(d["country"]) == d["primary"]) & (F.col("n_missing_allcols") <= d["missing"]))
        return V.pv_categories(kept, o["template"], o["n"], o["cuts"], o["labels"])

    def sample(self) -> dict[str, DataFrame]:
        d, o = self.data, self.outcome
        every = self.ingest().where(F.col(d["country"]) == d["primary"])
        flow = V.sample_flow(every, "n_missing_allcols", d["cluster"], sorted({d["missing"], *d["sensitivity"]}))
        whole = every.agg(F.lit(None).cast("int").alias("threshold"), F.count("*").alias("n"), F.lit(None).cast("long").alias("n_psu"))
        rows, w = self.rows(), F.col(d["weight"])
        replicates = [F.col(d["replicates"].format(i=i)) for i in range(1, d["n_replicates"] + 1)]
        cats = [f"cat_pv{i}" for i in range(1, o["n"] + 1)]
        found = [c for c in self.allowed.expand(rows.columns) if c in rows.columns]
        out = {"sample_flow": whole.unionByName(flow), "instability": V.instability(rows, cats, o["labels"], w), "design": V.design_diagnostics(rows, d["cluster"], d["weight"], d["stratum"], d["n_replicates"]), "proportions": V.brr_shares(rows, [], F.col("cat_pv1"), o["labels"], w, replicates, d["fay_k"])}
        if found:
            long = rows.select(d["weight"], *[d["replicates"].format(i=i) for i in range(1, d["n_replicates"] + 1)], *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in found])
            keep = [c for c in long.columns if c not in found]
            out["item_means"] = V.brr(long.unpivot(keep, [F.col(f"`{c}`") for c in found], "item", "value"), ["item"], V.finite(F.col("value")), w, replicates, d["fay_k"])
        return out

    def nested(self) -> DataFrame:
        """One row for each task, plausible value and outer fold; folds done before aren't run again."""
        d, o, c = self.data, self.outcome, self.cv
        rows, store, out = self.rows(), tables.FoldStore(self.spark, self.cfg.paths.checkpoints), []
        features = self.allowed.expand(rows.columns)
        G.assert_no_leakage(features, where="nested")
        select = {None: lambda: None, "su": lambda: selectors.SymmetricUncertainty(c["k"]), "chi2": lambda: selectors.ChiSquared(c["k"]), "mi": lambda: selectors.MutualInformation(c["k"]), "relieff": lambda: selectors.ReliefF(c["k"])}[c["selector"]]
        cfg = models.NestedCV(c["outer_splits"], c["outer_repeats"], c["inner_splits"], seed=self.cfg.seed)
        for low, high in o["tasks"]:
            for i in c["pvs"]:
                task = V.task_rows(rows, f"cat_pv{i}", low, high)
                task = task.withColumns({f: F.expr(f"try_cast(`{f}` as double)") for f in features})
                if i == c["pvs"][0]:
                    G.single_variable_screen(task.unpivot(["y"], [F.col(f"`{f}`") for f in features], "feature", "value"), "y", ceiling=c["ceiling"], signed_off=self.allowed.signed_off)
                out += models.run_nested(task, features, "y", d["cluster"], models.get_models(c["models"], c["fast"], self.cfg.seed), cfg, selector=select, key=c["key"], weight=d["weight"], task=f"{low}-{high}", pv=i, method=c["selector"] or "none", store=store)
        keep = ("task", "pv", "method", "rep", "fold", "best_model", "inner_score", "threshold", "n_train", "n_test", "auc", "balanced_accuracy", "w_auc", "selected")
        return self.spark.createDataFrame([tuple(r[k] for k in keep) for r in out], "task string, pv int, method string, rep int, fold int, best_model string, inner_score double, threshold double, n_train long, n_test long, auc double, balanced_accuracy double, w_auc double, selected array<string>")

    def assets(self) -> dict:
        return manifest.write_manifest(self.spark, self.cfg.paths.results, config=self.cfg.hash(), environment=environment_report(self.spark))

    def run(self, stages: Sequence[str] = STAGES) -> dict:
        if unknown := [s for s in stages if s not in STAGES]:
            raise ValueError(f"unknown stages {unknown}; there are {STAGES}")
        done: dict = {}
        for stage in (s for s in STAGES if s in stages):
            log.info("stage %s", stage)
            got = getattr(self, stage)()
            if stage in ("audit", "sample"):
                got = {name: tables.emit(df, name, f"{self.cfg.paths.results}/{stage}", most=5000) for name, df in got.items()}
            elif stage == "nested":
                got.write.mode("overwrite").parquet(f"{self.cfg.paths.results}/nested")
            done[stage] = got
        return done


def main(argv: Sequence[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--config", required=True)
    parser.add_argument("--stages", default=",".join(STAGES))
    args = parser.parse_args(argv)
    return Analysis(SparkSession.builder.getOrCreate(), Config.load(args.config)).run(args.stages.split(","))


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO)
    main()
