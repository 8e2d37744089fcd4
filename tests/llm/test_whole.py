"""Cases in which an operator once did less than the whole job."""

import random

from veyra.llm import lines, neardup, warc


def test_near_copy_of_one_member_of_a_large_group(spark):
    """Each odd document is a near copy of one member only of a large group of near copies."""
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    base, rows = words(300), []
    for i in range(600):
        member = base[:100] + words(20) + base[120:]
        rows.append((i, " ".join(member)))
        if i < 60:
            rows.append((1000 + i, " ".join(member[:200] + words(36) + member[236:])))
    for i, t in rows[1:120:2]:
        s, r = set(neardup.shingles(t).tolist()), set(neardup.shingles(rows[0][1]).tolist())
        assert i == 1000 or len(s & r) / len(s | r) < 0.7
    got = neardup.cluster(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {r["component_id"] for r in got} == {0}


def _gone(spark, rows):
    return {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_run_whose_pairs_stand_earlier_elsewhere(spark):
    """A pair of lines of the passage stands in an unrelated document first, whichever of its two pairs is the fingerprint."""
    rows, want = [], {}
    for i in range(0, 200, 10):
        a, b, c = f"a{i}", f"b{i}", f"c{i}"
        rows += [(i, f"x{i}\n{a}\n{b}\ny{i}"), (i + 1, f"u{i}\n{b}\n{c}\nv{i}"), (i + 2, f"{a}\n{b}\n{c}"), (i + 3, f"{a}\n{b}\n{c}\nz{i}")]
        want |= {i: (rows[-4][1], 0), i + 1: (rows[-3][1], 0), i + 2: (rows[-2][1], 0), i + 3: (f"z{i}", 3)}
    assert _gone(spark, rows) == want


def test_long_repeats_of_one_or_two_lines(spark):
    long, half = " ".join(f"w{i}" for i in range(51)), [" ".join(f"{c}{i}" for i in range(n)) for c, n in (("p", 26), ("q", 25), ("r", 24))]
    rows = [(1, long), (2, long), (3, f"a\n{long}\nb"), (4, "\n".join(half[:2])), (5, "\n".join(["c", *half[:2]])), (6, "\n".join(half[1:])), (7, "\n".join([*half[1:], "d"])), (8, " ".join(long.split()[:50])), (9, " ".join(long.split()[:50]))]
    got = _gone(spark, rows)
    assert got == {k: (t, 0) for k, t in rows} | {2: ("", 1), 3: ("a\nb", 1), 5: ("c", 2)}


def test_null_page_id_among_equal_payloads(spark, tmp_path):
    warc.register(spark)
    path, html = f"file://{tmp_path}/w", "a" * 2000
    rows = [(1, "u", html), (2, "u", html), (None, "u", html), (None, "v", "b" * 1500), (None, "v", "b" * 1500)]
    warc.with_revisits(spark.createDataFrame(rows, "page_id long, url string, html string")).write.format("warc").mode("append").save(path)
    got = sorted((str(r["page_id"]), r["record_type"], r["payload_bytes"], bytes(r["payload"] or b"").decode()) for r in spark.read.format("warc").load(path).collect())
    none = ("None", "response")
    assert got == [("1", "revisit", 2000, ""), ("2", "response", 2000, html), (*none, 1500, "b" * 1500), (*none, 1500, "b" * 1500), (*none, 2000, html)]
