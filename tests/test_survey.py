"""Hand-computed values, invariants, and every registered query against its SQL on the small tables."""

import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from veyra.operators import selection as S
from veyra.operators import survey as V
from veyra import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_category_edges(spark):
    rows = spark.createDataFrame([(-3.0,), (10.25,), (10.5,), (10.75,), (20.0,), (20.25,), (float("inf"),), (None,)], "x double")
    got = [r[0] for r in rows.select(V.categorize(F.col("x"), (10.5, 20.25), ("L", "M", "H"))).collect()]
    assert got == ["L", "L", "M", "M", "M", "H", "H", None]


def test_weighted_mean_skips_missing(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 2.0), (None, 9.0)], "x double, w double")
    assert rows.agg(V.weighted_mean(F.col("x"), F.col("w"))).first()[0] == 2.25


def test_identical_replicates_have_no_error(spark):
    rows = spark.createDataFrame([(float(i), 1.0 + i % 3) for i in range(50)], "x double, w double")
    got = V.brr(rows, [], F.col("x"), F.col("w"), [F.col("w")] * 10).first()
    assert got["brr_se"] == 0 and got["n_replicates_used"] == 10


def test_rubin_identity(spark):
    rows = spark.createDataFrame([(e, 0.25) for e in (6.0, 7.0, 9.0, 10.0)], "e double, v double")
    got = V.rubin(rows, [], "e", "v").first()
    assert math.isclose(got["between"], 10 / 3) and math.isclose(got["total_var"], 0.25 + 1.25 * 10 / 3) and got["q_bar"] == 8


def test_cohens_d_value(spark):
    rows = spark.createDataFrame([(float(x), 1) for x in (2, 4, 4, 6)] + [(float(x), 0) for x in (1, 3, 5, 7, 9)], "x double, g int")
    got = S.cohens_d(rows, [], "x", "g").first()
    assert math.isclose(got["d"], -1 / math.sqrt(48 / 7)) and got["band"] == "small"


def test_corrections(spark):
    rows = spark.createDataFrame([("f", i, p) for i, p in enumerate((0.01, 0.02, 0.03, 0.04, None))], "f string, i int, p double")
    got = [(r["holm"], r["bh"]) for r in S.adjust(rows, ["f"], "p", "i").orderBy("i").collect()]
    assert [round(h, 9) for h, _ in got[:4]] == [0.04, 0.06, 0.06, 0.06] and [round(b, 9) for _, b in got[:4]] == [0.04] * 4 and got[4] == (None, None)


def test_metrics_sum_to_one(spark):
    rows = spark.range(200).select((F.col("id") % 2).alias("y"), ((F.col("id") * 37) % 100 / 100).alias("s"))
    got = V.confusion_metrics(rows, [], "y", F.col("s"), 0.5, F.lit(1.0)).first()
    assert math.isclose(got["recall"] + got["fnr"], 1) and math.isclose(got["specificity"] + got["fpr"], 1)


def test_t_distribution():
    from veyra.functions.dist import t_cdf, t_ppf, two_sided_p

    assert math.isclose(t_ppf(0.975, 4), 2.7764451051977987, rel_tol=1e-9) and math.isclose(t_cdf(1.0, 1), 0.75, rel_tol=1e-12) and math.isclose(two_sided_p(2.0, math.inf), 0.04550026389635842, rel_tol=1e-9)


def test_guard_finds_derived_names():
    from veyra.operators import guard as G

    assert set(G.forbidden(["log_PV1MATH", "pv3math_1", "ST004"], [r"PV\d+MATH"], prefixes=["LOG_"])) == {"log_PV1MATH", "pv3math_1"}
    with pytest.raises(G.LeakageError):
        G.assert_no_leakage(["PV1MATH"], [r"PV\d+MATH"], "test")


def test_interval_holds_the_estimate(spark):
    from veyra.operators import resample as R

    rows = spark.range(600).select((F.col("id") % 20).alias("g"), (F.col("id") * 7 % 10 < 4).cast("int").alias("y"), ((F.col("id") * 7 % 10 < 4).cast("int") * 20 + F.col("id") * 37 % 50).cast("double").alias("s"))
    got = R.cluster_interval(rows, "g", "y", "s", replicates=200)
    assert got["ci_low"] <= V.auc(rows, [], "y", "s").first()[0] <= got["ci_high"]


#: Queries without SQL that fit models or search; test_modelling.py holds their operators to invariants.
SLOW = {"nested_cv", "binary_swarm", "variable_length_swarm", "local_surrogates", "permutation_importance", "bootstrap_interval", "sampled_shap"}


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - SLOW))
def test_query_against_sql(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    ours = plans.QUERIES[name](spark, d)
    if name not in plans.ORACLE:
        assert ours.count() > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    theirs = con.execute(plans.ORACLE[name])
    names = [c[0] for c in theirs.description]
    assert sorted(names) == sorted(ours.columns)
    plain = lambda row: repr([float(v) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else v for v in row])
    assert sorted(plain([r[c] for c in sorted(names)]) for r in ours.collect()) == sorted(plain([r[names.index(c)] for c in sorted(names)]) for r in theirs.fetchall())
