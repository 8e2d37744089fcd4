"""The staged analysis on a small made-up survey."""

import random

import pytest

from veyra.plans.analysis import Analysis, main
from veyra.sources import tables
from veyra.sources.config import Config


@pytest.fixture(scope="module")
def settings(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("analysis")
    rng = random.Random(5)
    rows = []
    for i in range(400):
        able = rng.gauss(500, 90)
        rows.append((i, "ESP" if i % 8 else "PRT", i // 16, f"S{i % 3}", 1.0 + i % 4, *[able + rng.gauss(0, 20) for _ in range(3)], *[(1.0 + i % 4) * (1.5 if (i // 16 * r) % 7 % 2 else 0.5) for r in range(1, 6)], able / 90 + rng.gauss(0, 1), str(i % 5) if i % 11 else None))
    names = ["id long", "CNT string", "CNTSCHID long", "STRATUM string", "W_FSTUWT double", *[f"PV{i}MATH double" for i in (1, 2, 3)], *[f"W_FSTURWT{i} double" for i in range(1, 6)], "ST1 double", "ST2 string"]
    spark.createDataFrame(rows, ", ".join(names)).write.parquet(f"{base}/raw.parquet")
    (base / "c.yaml").write_text(f"""seeds: {{base: 3}}
data: {{source: '{base}/raw.parquet', primary: ESP, external: [PRT], n_replicates: 5, missing: 3, sensitivity: [0]}}
outcome: {{n: 3, cuts: [470, 540], tasks: [[Low, High]]}}
cv: {{outer_splits: 2, outer_repeats: 1, inner_splits: 2, models: [DecisionTree], fast: true}}
predictors: {{ST1: {{justification: x}}, ST2: {{justification: y}}}}
""")
    return base


def test_stages(spark, settings):
    cfg = Config.load(f"{settings}/c.yaml", root=settings)
    done = Analysis(spark, cfg).run()
    assert done["ingest"].count() == 400 and set(done["audit"]) == {"column_classification", "reclassified", "stump_accuracy"}
    flow = spark.read.option("header", True).csv(done["sample"]["sample_flow"]["csv"]).collect()
    assert {r["threshold"]: int(r["n"]) for r in flow} == {None: 350, "0": 318, "3": 350}
    shares = spark.read.option("header", True).csv(done["sample"]["proportions"]["csv"]).collect()
    assert abs(sum(float(r["estimate"]) for r in shares) - 1) < 1e-9 and done["sample"]["item_means"]
    folds = spark.read.parquet(f"{settings}/results/nested").collect()
    assert len(folds) == 2 and all(r["auc"] > 0.6 for r in folds) and done["assets"]["n_files"] > 10
    stump = spark.read.option("header", True).csv(done["audit"]["stump_accuracy"]["csv"]).first()
    assert float(stump["accuracy"]) == 1.0
    with pytest.raises(ValueError):
        Analysis(spark, cfg).run(["cook"])
    with pytest.raises(SystemExit):
        main([])


def test_staging_of_raw_files(tmp_path):
    raw = tmp_path / "a.sav"
    raw.write_bytes(b"x" * 1000)
    there = tables.stage_locally(str(raw), str(tmp_path / "fast"), 0)
    assert there != str(raw) and open(there, "rb").read() == b"x" * 1000 and tables.stage_locally(str(raw), str(tmp_path / "fast"), 0) == there
    assert tables.stage_locally(str(raw), str(tmp_path / "other"), 1e9) == str(raw)
