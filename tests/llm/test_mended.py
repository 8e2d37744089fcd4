"""Losses, crashes and clashes that once were, and awkward rows, for each operator."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veyra.llm import bpe, decontaminate, lines, neardup, reshard, secrets, suffix, topk, toxicity, warc

KIND = "doc_id long, text string, n_words int, hits string, items int, base int, spans int, more string, size int, shard int, block int, slot int, old_shard int, start int, score int, n_lines string, n_removed int"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, *[7 if k.endswith("int") else "7" for k in KIND.split(", ")[2:]]) for i, t in rows], KIND)


LONG = "word " * 60_000


def files(path):
    return {f"{d}/{n}": open(f"{d}/{n}", "rb").read() for d, _, names in os.walk(path) for n in names if n.startswith("part-")}


def test_rewriting_leaves_other_shards(spark, tmp_path):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit(1).alias("size"))
    first = reshard.reshard(docs, F.col("doc_id") % 3, 3, 3)
    path = f"file://{tmp_path}/layout"
    reshard.rewrite(first.withColumn("old_shard", F.col("shard")), path)
    before = files(f"{tmp_path}/layout")
    moved = first.withColumn("old_shard", F.col("shard")).withColumn("shard", F.when((F.col("shard") == 0) & (F.col("block") % 2 == 0), 1).otherwise(F.col("shard")))
    reshard.rewrite(moved, path)
    after = files(f"{tmp_path}/layout")
    untouched = {p: b for p, b in before.items() if "/shard=2/" in p}
    assert untouched and {p: b for p, b in after.items() if "/shard=2/" in p} == untouched
    back = spark.read.parquet(path)
    assert back.count() == 900 and {tuple(r) for r in back.select("doc_id", "shard").collect()} == {tuple(r) for r in moved.select("doc_id", "shard").collect()}
    reshard.rewrite(moved.withColumn("old_shard", F.col("shard")).withColumn("shard", F.when(F.col("shard") == 0, 2).otherwise(F.col("shard"))), path)
    spark.catalog.refreshByPath(path)
    assert sorted(os.listdir(f"{tmp_path}/layout"))[-2:] == ["shard=1", "shard=2"] and not os.path.exists(f"{tmp_path}/layout/shard=0")


def test_flow_moves_the_least(spark):
    """Against all ways to split small supplies."""
    from itertools import product

    rng = random.Random(2)
    for _ in range(30):
        n, m = rng.randint(1, 3), rng.randint(1, 3)
        supply = [rng.randint(0, 3) for _ in range(n)]
        demand = [sum(supply) // m + (j < sum(supply) % m) for j in range(m)]
        flow = reshard.min_cost_flow(supply, demand, lambda i, j: int(i != j))
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(n)] == supply and [sum(v for (_, j), v in flow.items() if j == k) for k in range(m)] == demand
        least = min(sum(v for (i, j), v in zip(product(range(n), range(m)), x) if i != j) for x in product(range(4), repeat=n * m) if [sum(x[i * m : i * m + m]) for i in range(n)] == supply and [sum(x[j::m]) for j in range(m)] == demand)
        assert sum(v for (i, j), v in flow.items() if i != j) == least


def test_resharding_of_hot_ids_and_clashes(spark):
    rows = clashing(spark, [(None, f"t{i}") for i in range(400)] + [(1, f"u{i}") for i in range(400)] + [(2, None), (2, None), (3, LONG)])
    out = reshard.reshard(rows, F.lit(0), 1, 5, per_shard=64)
    assert set(rows.columns) <= set(out.columns) and len(out.columns) == len(set(out.columns)) == len(rows.columns)
    got = out.collect()
    assert len(got) == 803 and all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got))) for s in range(5))
    assert {r["start"] for r in got} == {7} and max(sum(r["shard"] == s for r in got) for s in range(1, 5)) > 50


def test_secret_patterns_on_long_texts(spark):
    """Patterns must not recurse on the text's length."""
    texts = ["Aa_" * 300_000, "Ab-" * 20_000 + "x", "a" * 1_000_000, "0" * 300_000, LONG, None, "", "key: Qw" + "zK7pLm9XvR2tYb4N"]
    got = secrets.scan(clashing(spark, list(enumerate(texts))), "text").select("doc_id", "spans", "start", "more").orderBy("doc_id").collect()
    assert [r["more"] for r in got] == ["7"] * 8 and {r["start"] for r in got} == {7}
    kinds = [[s["kind"] for s in r["spans"]] for r in got]
    assert kinds[0] == [] and kinds[1] == [] and kinds[3] == ["hex"] and kinds[5] == kinds[6] == []


def test_entropy_spans_against_brute_force(spark):
    rng = random.Random(4)
    chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
    words = ["".join(rng.choice(chars[: rng.choice([3, 16, 52, 67])]) for _ in range(rng.randrange(18, 60))) for _ in range(300)]
    words += ["some-long-name-of-words-here", "SomeLongCamelCaseNameWithWords", "123e4567-e89b-12d3-a456-426614174000", "A" * 40, "kQpZrXwTyUvNmLsJhGfD"]

    def peak(w):
        return max(-sum(c / 20 * np.log2(c / 20) for c in [w[i : i + 20].count(x) for x in set(w[i : i + 20])]) for i in range(len(w) - 19))

    def secret(w):
        if any(re.search(p, w) for p in secrets.ALLOWED) or re.search(secrets.WORDS[0], w) and not re.search(secrets.WORDS[1], w):
            return False
        return peak(w) >= next(v for _, p, v in secrets.CLASSES if re.search(p, w)) - 1e-12

    text = " ".join(words)
    want = {(m.start(), m.end()) for m in re.finditer(secrets.CANDIDATE, text) if secret(m[0])}
    got = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"]
    assert {(s["start"], s["end"]) for s in got if s["kind"] == "entropy"} == want and len(want) > 50
    assert not secret(words[-5]) and not secret(words[-4]) and not secret(words[-3]) and not secret(words[-2]) and secret(words[-1])


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-4, 5, 6).astype(float).tolist()) for i in range(700)]
    rows += [(700, None), (701, [1.0] * 5), (702, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (703, [float("nan")] * 6), (704, [float("inf")] * 6), (None, [1.0] * 6), (705, [])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, v array<double>"), F.col("vec_id") % 50 == 0, k=9, block_rows=16, tier_blocks=4, query_rows=5).collect()
    v = {i: np.array(x) for i, x in rows[:700]}
    want = {(q, r + 1, c, int(-s)) for q in range(0, 700, 50) for r, (s, c) in enumerate(sorted((-float(v[q] @ v[c]), c) for c in v if c != q)[:9])}
    assert {tuple(r) for r in got} == want


def test_topk_blocks_are_runs_of_the_order(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(100)], "vec_id long, v array<double>")
    assert topk.search(rows, F.col("vec_id") == 3, k=5, block_rows=7, tier_blocks=3).orderBy("rank").select("vec_id").collect()[0][0] == 99
    assert topk.search(rows.where("vec_id is null"), F.col("vec_id") == 3).count() == 0


@pytest.mark.parametrize("bytes_from", [0, 10**18])
def test_topk_reads_a_tier_once_for_many_queries(spark, monkeypatch, tmp_path, bytes_from):
    from pyarrow import fs

    log, real = str(tmp_path / "reads"), topk._store

    def counting(uri):
        class Counting(fs.LocalFileSystem):
            def open_input_stream(self, *a, **k):
                with open(log, "a") as f:
                    f.write(".")
                return super().open_input_stream(*a, **k)

        return Counting(), real(uri)[1]

    monkeypatch.setattr(topk, "_store", counting)
    monkeypatch.setattr(topk, "EIGHT", bytes_from, raising=False)
    rng = np.random.default_rng(5)
    v = rng.integers(-9, 10, (3000, 8))  # unrelated directions, ties, and more blocks than are kept
    v[::70] = v[0]
    wide = [(3000, [9000.0] * 8), (3001, [-9000.0] * 8), (3002, [5000.0] + [0.0] * 7), (3005, [9000.0] * 7 + [8999.0])]  # over 32-bit products
    rows = [(i, x) for i, x in enumerate(v.astype(float).tolist())] + (wide if bytes_from else []) + [(40, v[7].astype(float).tolist())]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, v array<double>"), F.col("vec_id") % 20 == 0, k=6, block_rows=8, tier_blocks=4, query_rows=64, cached=8).collect()
    want, every, ids = [], np.array([x for _, x in rows]), np.array([i for i, _ in rows])
    for i, x in rows:
        if i % 20 == 0:
            s = every @ np.array(x)
            best = [c for c in np.lexsort((ids, -s)) if ids[c] != i][:6]
            want += [(i, r + 1, int(ids[c]), int(s[c])) for r, c in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert 0 < os.path.getsize(log) < 2000  # 157 queries and some 100 tiers: in a round a group reads a tier once at most


def test_topk_products_of_bytes_dont_saturate():
    eight = topk._eight()
    q, m = np.array([[63] * 70, [-64] * 70, list(range(-35, 35))]), np.array([[127] * 70, [-127] * 70, list(range(70))])
    if eight is not None:
        assert (eight((q + 64).astype(np.uint8), m.T.astype(np.int8)) == q @ m.T).all()


def test_archives_roll_over_and_filter(spark, tmp_path):
    warc.register(spark)
    rows = spark.range(500).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 7, F.lit("/")).alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 40).alias("html")).repartition(2)
    path = f"file://{tmp_path}/w"
    warc.with_revisits(rows).write.format("warc").option("maxFileBytes", 50_000).mode("append").save(path)
    assert len([n for n in os.listdir(tmp_path / "w") if n.endswith(".warc.gz")]) > 3
    back = spark.read.format("warc").load(path)
    assert back.count() == 500 and back.where("page_id in (3, 4, 900)").count() == 2 and back.where("target_uri like 'http://h3%'").count() == 71 and back.where("refers_to is not null").count() == 0
    assert warc.with_revisits(rows.limit(0)).count() == 0


def test_hot_anchors_split(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 2)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shared, texts = word(120), []
    for _ in range(40):  # one hot anchor with many surroundings, some of which repeat
        texts.append(word(rng.randrange(150)) + shared + word(rng.randrange(150)))
    passage = word(100) + shared + word(100)
    texts += [word(80) + passage + word(60), passage[:250], passage[60:], word(30) + passage[30:290], "y" * 900, "y" * 450 + word(100)]
    rows = list(enumerate(texts))
    got = sorted(tuple(r) for r in suffix.cut(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) h").collect())
    assert got == sorted((i, *w) for (i, _), w in zip(rows, suffix.brute_force(texts)))


def test_lines_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randrange(9)))) for i in range(120)] + [(500, LONG + "\n" + LONG), (501, None), (None, "a\nb\nc"), (502, "x\n" + LONG)]
    seen, want = set(), {}
    for i, t in [r for r in rows if r[0] is not None and r[1] is not None] + [rows[-2]]:
        ls, gone = t.split("\n"), set()
        for at in range(len(ls)):
            for n in (1, 2, 3):
                run = tuple(ls[at : at + n])
                if len(run) == n and (n == 3 or sum(len(x.split()) for x in run) > 50):
                    if run in seen:
                        gone |= set(range(at, at + n))
                    seen.add(run)
        want[i] = "\n".join(x for k, x in enumerate(ls) if k not in gone)
    out = lines.dedup(clashing(spark, rows))
    got = {r["doc_id"]: (r["text"], r["more"]) for r in out.collect()}
    assert {i: t for i, (t, _) in got.items() if i != 501} == want and got[501][0] is None and {m for _, m in got.values()} == {"7"}
    assert lines.dedup(clashing(spark, [])).count() == 0


def test_pairs_of_twins_in_a_template(spark):
    """Twins at 0.77 among documents at 0.68 to each other: every pair must be linked."""
    rng = random.Random(9)
    words = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    base, rows = words(260), []
    for i in range(120):
        twin = base[:240] + words(50)
        rows += [(2 * i, " ".join(twin)), (2 * i + 1, " ".join(twin[:-6] + words(36)))]
    sets = {i: set(neardup.shingles(t).tolist()) for i, t in rows}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            if near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = neardup.cluster(clashing(spark, rows).repartition(5)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: find(i) for i in sets} and len({find(i) for i in sets}) > 50


def test_rows_of_one_id(spark):
    rng = random.Random(1)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b = say(200), say(200)
    rows = [(1, a), (1, b), (2, a + " x"), (3, b.replace(" ", " q ", 1)), (4, say(50)), (4, say(60)), (None, a), (5, None), (5, "")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in neardup.cluster(clashing(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (None, None), (5, 5), (5, 5)], key=str)


@pytest.mark.parametrize("run", [
    lambda d: bpe.encode(d, __import__("public_tokenizers").path("byte_bpe_multi_50k.tiktoken"), __import__("public_tokenizers").PATTERN),
    lambda d: toxicity.score(d, toxicity.Machine(["abcd"], np.ones(1, np.float32), -1.0)),
    lambda d: secrets.scan(d),
    lambda d: reshard.reshard(d, F.lit(0), 1, 3),
    lambda d: decontaminate.contaminated(decontaminate.find(d, d, item_col="doc_id")),
    lambda d: suffix.cut(d),
    lambda d: neardup.cluster(d),
    lambda d: lines.dedup(d),
], ids="bpe toxicity secrets reshard decontaminate suffix neardup lines".split())
def test_awkward_rows(spark, run):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names, and nothing at all."""
    rows = [(1, None), (2, ""), (3, LONG), (3, LONG), (4, "tie"), (5, "tie"), (None, "tie"), (None, None), (6, "\x00é\n\n")]
    assert run(clashing(spark, rows)).count() == len(rows)
    assert run(clashing(spark, [])).count() == 0


def test_bpe_nulls_and_repeats(spark):
    import public_tokenizers as p

    rows = spark.createDataFrame([(1, None), (2, ""), (3, "ab ab"), (3, "ab ab")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_tokens"], bytes(r["decoded"])) for r in bpe.encode(rows, p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN).collect())
    assert got[:2] == [(1, 0, b""), (2, 0, b"")] and got[2] == got[3] and got[2][2] == b"ab ab"


def test_fit_takes_all_drawn_texts_for_the_cut():
    machine = toxicity.Machine(["abcd"], np.ones(1, np.float32), 0.0)
    margins = [(0.1, 0)] * 5000 + [(0.4, 0)] * 200 + [(0.3, 1)] * 100 + [(0.9, 1)] * 900
    assert toxicity.cut(machine, margins).bias == pytest.approx(-0.65)


def test_intermediate_folders_can_be_released(spark):
    from veyra.llm import common

    common.release(spark)
    kept = common.materialize(spark.range(10), "some")
    path = common._MADE[-1].removeprefix("file://")
    assert kept.count() == 10 and os.path.isdir(path) and common.release(spark) == 1 and not os.path.exists(path)
