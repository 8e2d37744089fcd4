"""How the work of statistics grows: what is shuffled, by task and in all, and plans that would be quadratic or repeat themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veyra.operators import resample as R


def stages(spark, action):
    """Runs action and returns the stages that it started."""
    sc = spark.sparkContext
    store, jvm = sc._jsc.sc().statusStore(), sc._jvm
    every = lambda: [s for s in jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList()))]
    before = {s.stageId() for s in every()}
    action()
    return [s for s in every() if s.stageId() not in before]


def pairs(y, s, w):
    """AUC by all pairs."""
    win = (s[:, None] > s[None, :]) + 0.5 * (s[:, None] == s[None, :])
    p, n = w * y, w * (1 - y)
    return float(p @ win @ n / (p.sum() * n.sum()))


# ---- bootstrap
def test_bootstrap_has_no_row_for_each_cell_and_replicate(spark):
    rows = spark.range(20000).select((F.col("id") % 20).alias("g"), (F.col("id") % 3 == 0).cast("int").alias("y"), ((F.col("id") * 7919) % 10007).cast("double").alias("s"))
    m = R.multiplicities(rows, "g", 60)
    done = stages(spark, lambda: R.bootstrap_auc(rows, "g", "y", "s", m).collect())
    assert sum(s.shuffleWriteRecords() for s in done) < 200_000  # 20,000 cells; 1,200,000 of cells and replicates


@pytest.mark.parametrize("cells", [40, 1 << 19])
def test_bootstrap_against_all_pairs(spark, monkeypatch, cells):
    """Ties within and across batches and tasks, labels that are missing, clusters and replicates in blocks."""
    from veyra.operators import replicates

    monkeypatch.setattr(replicates, "CELLS", cells)
    monkeypatch.setattr(R, "MULTIPLICITIES", 30)
    rng = np.random.default_rng(3)
    g, y, s = rng.integers(0, 10, 700), rng.integers(0, 3, 700), rng.integers(0, 4, 700).astype(float)
    rows = spark.createDataFrame([(int(a), int(b) if b < 2 else None, float(c)) for a, b, c in zip(g, y, s)], "g long, y int, s double").repartition(5)
    m = R.multiplicities(rows, "g", 7, 1)
    times = {(r["rep"], r["g"]): r["m"] for r in m.collect()}
    got = {r["rep"]: r["auc"] for r in R.bootstrap_auc(rows, "g", "y", "s", m).collect()}
    known = y < 2
    want = {r: pairs(y[known], s[known], np.array([times.get((r, int(c)), 0) for c in g[known]], dtype=float)) for r in range(7)}
    assert got.keys() == want.keys() and all(abs(got[r] - want[r]) < 1e-12 for r in want)


# ---- names
def test_forbidden_names_makes_forms_once_a_name(spark):
    from veyra.operators import guard as G

    rows = spark.range(3000).select(F.col("id"), F.element_at(F.array(F.lit("log_PV1MATH"), F.lit("ST004"), F.lit(None), F.lit(" math_score"), F.lit("")), (F.col("id") % 5 + 1).cast("int")).alias("name"))
    got = G.forbidden_names(rows, "name")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MISSINGINDICATOR_") <= 2 and plan.count("Aggregate") >= 2  # 43 copies of all forms, beneath the first reading, before
    assert {(r["name"], r["pattern"]) for r in got.collect()} == {("log_PV1MATH", "PV\\d+MATH"), (" math_score", "math_score")} and got.count() == 1200
    assert got.columns == ["id", "name", "pattern"]


# ---- bins and orders
def test_bins_shuffle_no_rows(spark):
    from veyra.operators import selection as S

    rows = spark.range(30000).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 40).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    for query in (lambda t: S.decile_bins(t).groupBy("feature", "bin").count(), lambda t: S.symmetric_uncertainty(S.decile_bins(t), "y"), lambda t: S.entropy(S.decile_bins(t), ["feature"], "bin"), lambda t: S.conditional_entropy(S.decile_bins(t), ["feature"], "bin", "y")):
        done = stages(spark, query(S.unpivot(rows, ["y"], ["a", "b"])).collect)
        assert sum(s.shuffleWriteRecords() for s in done) < 10_000  # 60,000 rows and more, all of a feature in one task, before


def test_a_large_group_is_cut_whatever_stands_beside_it(spark, monkeypatch):
    from veyra.operators import ordered

    monkeypatch.setattr(ordered, "LARGE", 1000)
    rows = spark.range(20000).select(F.when(F.col("id") < 16000, "a").when(F.col("id") < 19990, F.col("id").cast("string")).alias("g"), ((F.col("id") * 7919) % 20011).cast("double").alias("x"))
    got = ordered.counted(rows, ["g"], "x")
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan  # by group: the window over its pieces kept that order, so that a group was one task
    want, last = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r["x"]):
        want[r["g"], r["x"]] = last.get(r["g"], 0)
        last[r["g"]] = last.get(r["g"], 0) + 1
    assert {(r["g"], r["x"]): r["below_n"] for r in got.collect()} == want


# ---- corrections
@pytest.mark.parametrize("family", [[], ["g"]])
def test_corrections_of_large_families(spark, monkeypatch, family):
    """Against the definition, with ties, a family of one test, and families that are cut into pieces."""
    from veyra.operators import ordered
    from veyra.operators import selection as S

    monkeypatch.setattr(ordered, "LARGE", 100)
    rows = spark.range(3000).select("id", F.when(F.col("id") == 0, "c").when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), F.when(F.col("id") % 50 != 7, ((F.col("id") * 7919) % 809) / 1000.0).alias("p"))
    got = S.adjust(rows, family, "p", "id")
    assert "currentrow$(), unboundedfollowing" not in got._jdf.queryExecution().analyzed().toString().lower()  # that frame starts anew at every row
    groups = {}
    for r in rows.where("p is not null").collect():
        groups.setdefault(r["g"] if family else 0, []).append((r["p"], r["id"]))
    want = {}
    for tests in groups.values():
        tests.sort()
        m, high, low = len(tests), 0.0, 2.0
        holm = [high := max(high, (m - i) * p) for i, (p, _) in enumerate(tests)]
        bh = [low := min(low, m / (i + 1) * tests[i][0]) for i in reversed(range(m))][::-1]
        want |= {k: (min(1.0, h), min(1.0, b)) for (_, k), h, b in zip(tests, holm, bh)}
    assert {r["id"]: (r["holm"], r["bh"]) for r in got.collect()} == {i: want.get(i, (None, None)) for i in range(3000)}


# ---- replicate weights
def test_replicate_weights_are_not_shuffled(spark):
    from veyra.operators import survey as V

    rows = spark.range(20000).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), ((F.col("id") * 7919) % 20011).cast("double").alias("s"))
    weights = [1.0 + F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(7)) for i in range(41)]
    done = stages(spark, V.brr_auc(rows, [], "y", "s", weights[0], weights[1:]).collect)
    assert sum(s.shuffleWriteBytes() for s in done) < 2_000_000  # 41 weights are 6,560,000 bytes


def test_replicated_auc_of_groups_against_all_pairs(spark):
    """Ties, a group that is NULL, scores that aren't finite, weights that are NULL, a group of one class."""
    from veyra.operators import survey as V

    rng = np.random.default_rng(5)
    told = [(["a", "b", None][i % 3], int(rng.integers(0, 2)), [float(rng.integers(0, 9)), float("nan")][i % 17 == 0], float(rng.integers(1, 5)), float(rng.integers(0, 3)) if i % 5 else None) for i in range(600)]
    rows = spark.createDataFrame([*told, ("one", 1, 2.0, 1.0, 1.0)], "g string, y int, s double, w double, v double").repartition(7)
    got = {r["g"]: r for r in V.brr_auc(rows.where("g is null or g <> 'one'"), ["g"], "y", "s", F.col("w"), [F.col("v"), F.col("w"), F.col("w") * 2]).collect()}
    assert got.keys() == {"a", "b", None}
    for g, r in got.items():
        part = [t for t in told if t[0] == g and t[2] == t[2]]
        y, s, w, v = (np.array([t[i] or 0 for t in part], dtype=float) for i in (1, 2, 3, 4))
        e, t = pairs(y, s, w), pairs(y, s, v)
        assert abs(r["estimate"] - e) < 1e-12 and abs(r["brr_variance"] - (t - e) ** 2 / (3 * 0.25)) < 1e-12 and r["n_replicates_used"] == 3
    from veyra.operators.replicates import replicated_auc

    y = F.col("y") == 1
    alone = replicated_auc(rows, ["g"], "s", y, ~y, [F.col("w")], np.stack, 1).where("g = 'one'").first()
    assert alone["t"] == [None]


# ---- permutations
def test_permutations_share_an_order_and_are_made_once(spark):
    from veyra.operators import survey as V

    n = 4000
    rows = spark.range(n).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 11).cast("double").alias("s"))
    got = []
    done = stages(spark, lambda: got.append(R.permutation_null(lambda t, seed: V.auc(t, [], "y", "s").first()[0], rows, "y", "id", 0.5, n=3)))
    assert sum(s.shuffleWriteRecords() for s in done) < 11 * n  # one order, and three shuffles of rows for each of three
    from veyra.operators import guard as G

    assert got[0]["distribution"] == [V.auc(G.permute_within(rows, [], "y", "id", i), [], "y", "s").first()[0] for i in range(3)]


# ---- neighbours and items
def test_nearest_rows_of_many_queries(spark):
    from veyra.operators import neighbours

    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 40, (60000, 2)).astype(float), rng.integers(0, 3, 60000)
    rows = spark.createDataFrame([(i, int(y[i]) if y[i] < 2 else None, float(x[i, 0]), float(x[i, 1])) for i in range(60000)], "k long, y int, a double, b double").repartition(2).cache()
    rows.count()
    got = []
    done = stages(spark, lambda: got.extend(neighbours.nearest(rows, rows.where("k < 300"), ["a", "b"], "k", 4, label="y").collect()))
    assert sum(s.executorRunTime() for s in done) < 15_000  # each query's rows were sorted anew for every 2,048 rows
    found = {(r["query"], r["label"], r["rank"]): (r["key"], r["distance"]) for r in got}
    assert len(found) == 300 * 2 * 4
    for q in (0, 17, 299):
        d = np.round(np.sqrt(((x - x[q]) ** 2).sum(1)), 9)
        for label in (0, 1):
            want = sorted((d[i], i) for i in np.flatnonzero(y == label) if i != q)[:4]
            assert [found[q, label, r][::-1] for r in range(1, 5)] == want


def test_only_first_pages_are_read_line_by_line(spark):
    from veyra.sources import codebook

    text = "CY7_2018_QST ST999Q01TA\nHow often\nST004\n(Please select one response.)\nNever Often\nST004Q01TA Sex\n01 02\n7"
    pages = spark.createDataFrame([(3, text.replace("Sex", "later")), (1, "none"), (2, text), (2, None), (4, text.replace("Q01TA", "Q02TA"))], "page int, text string")
    got = codebook.extract_items(pages)
    assert {(r["item"], r["page"], r["item_label"]) for r in got.collect()} == {("ST004Q01TA", 2, "Sex"), ("ST004Q02TA", 4, "Sex")}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("aggregate(") < plan.index("Join ")  # nearer to the result: pages are chosen first
