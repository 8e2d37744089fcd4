"""Each stage of the pipeline against a brute-force version on awkward rows."""

import random

import duckdb
import numpy as np
import pytest

import corpus_pipeline as cp
from veyra.llm import decontaminate, neardup, toxicity

D = "/root/testdata/sf0.001"
ITEM = duckdb.sql(f"select text from '{D}/benchmark.parquet' order by item_id").fetchall()[0][0]
KIND = "doc_id long, text string, lang string, source string, n_chars long, _k int, hits string, node long, shard int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    base, long = say(400), say(60)
    texts = [None, "", " \n ", base, base, base.replace(" ", " x ", 1), say(8000) + " " + ITEM + " " + say(8000), ITEM, "a b", say(30) + "\n" + long, say(40) + "\n" + long, "x" * 60_000, say(20_000)]
    out = [(i, t, "en", "s", len(t or ""), 1, "h", 2, 3) for i, t in enumerate(texts)]
    return [*out, out[3], out[0], (None, base, "en", "s", 1, 1, "h", 2, 3), (None, None, None, None, None, 1, "h", 2, 3), (None, say(50), None, None, None, 1, "h", 2, 3), (12, say(70), "en", "s", 1, 1, "h", 2, 3)]


def texts_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_each_stage_on_nothing(spark, rows):
    for name, stage in cp.STAGES:
        got = stage(spark, spark.createDataFrame(rows[:0], KIND), D)
        assert got.count() == 0 and (name == "tokens" or got.columns == cp.COLUMNS)


def test_near_copies_stage(spark, rows):
    docs = [(i, t) for i, t, *_ in rows]
    sets = [set(neardup.shingles(t).tolist()) for _, t in docs]
    group = list(range(len(docs)))
    changed = True
    while changed:
        changed = False
        for a in range(len(docs)):
            for b in range(len(docs)):
                both = len(sets[a] & sets[b])
                one = docs[a][0] is not None and docs[a][0] == docs[b][0] or docs[a] == docs[b]
                if (one or sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both)) and group[b] > group[a]:
                    group[b], changed = group[a], True
    want = len(set(group))
    got = texts_of(cp.near_out(spark, spark.createDataFrame(rows, KIND), D))
    least = {g: min((docs[i][0] for i in range(len(docs)) if group[i] == g and docs[i][0] is not None), default=None) for g in group}
    assert len(got) == want and sorted(str(i) for i, _ in got) == sorted(map(str, least.values())) and set(got) <= set(docs)


def test_lines_stage(spark, rows):
    docs = sorted({(i, t) for i, t, *_ in rows if t is not None}, key=lambda x: (x[0] is None, x[0] or 0))
    seen: set = set()
    want = {}
    for i, t in docs:  # in order: null ids last; texts of equal id in any order share no lines here
        lines, gone = t.split("\n"), set()
        for n in (1, 2, 3):
            for at in range(len(lines) - n + 1):
                run = tuple(lines[at : at + n])
                if n == 3 or sum(len(x.split()) for x in run) > 50:
                    if run in seen:
                        gone |= set(range(at, at + n))
                    seen.add(run)
        want[i, t] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    got = texts_of(cp.lines_out(spark, spark.createDataFrame(rows, KIND), D))
    keep = [(i, want.get((i, t), t)) for i, t, *_ in rows]
    assert got == sorted(((i, n) for (i, n), (_, t, *_) in zip(keep, rows) if n == t or n.strip()), key=str)


def test_leaks_stage(spark, rows):
    windows = {w for (t,) in duckdb.sql(f"select text from '{D}/benchmark.parquet'").fetchall() for w in decontaminate.windows_of(decontaminate.words_of(t), 13)}

    def leaks(t):
        words = decontaminate.words_of(t)
        line, hit = b" " + b" ".join(words) + b" ", set()
        for w in windows:
            at = line.find(b" " + w + b" ")
            while at >= 0:
                first = line.count(b" ", 0, at + 1) - 1
                hit |= set(range(first, first + w.count(b" ") + 1))
                at = line.find(b" " + w + b" ", at + 1)
        runs = [sum(i + k in hit for k in range(13)) == 13 for i in range(len(words))]
        return bool(hit) and (20 * len(hit) >= len(words) or any(runs))

    got = texts_of(cp.leaks_out(spark, spark.createDataFrame(rows, KIND), D))
    assert got == sorted(((i, t) for i, t, *_ in rows if not leaks(t)), key=str)
    assert not any(ITEM in (t or "") for _, t in got)


def test_hits_point_into_the_text(spark):
    text = "Ünter – " + ITEM.upper().replace(" ", " ;\t") + " … ende"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    (hit,) = decontaminate.find(docs, items).first()["hits"]
    words = decontaminate.words_of(text[hit["start"] : hit["end"]])
    assert words == decontaminate.words_of(text)[hit["a"] : hit["b"] + 1] == decontaminate.words_of(ITEM.upper())


def test_toxicity_stage(spark, rows):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    machine = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{D}/labels.parquet"))
    got = texts_of(cp.toxic_out(spark, spark.createDataFrame(rows, KIND), D))

    def bad(t):
        units = sorted(toxicity.units(t))
        return bool(units) and 1 / (1 + np.exp(-4 * machine.margins(units).max())) >= 0.5

    assert got == sorted(((i, t) for i, t, *_ in rows if not bad(t)), key=str)


def test_tokens_stage(spark, rows):
    import hashlib

    import public_tokenizers as p
    import tiktoken

    from veyra.llm import bpe

    other = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=bpe.load_ranks(p.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    rows = [r for r in rows if not (r[1] or "").startswith("xxxx")]  # the other library is slow on it; see test_bpe_as_tiktoken
    want = []
    for i, t, *_ in rows:
        ids = np.array(other.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r) for r in cp.tokens(spark, spark.createDataFrame(rows, KIND), D).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_whole_pipeline(spark):
    out = cp.run(spark, D)
    ids = [r["doc_id"] for r in out.collect()]
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and len(ids) == len(set(ids)) > 50
