"""Toxicity by a subsequence string-kernel machine on words.

The kernel between two strings sums their common subsequences of P characters, each weighted by DECAY for every gap,
so a word with inserted or missing characters stays near the insult it hides. Nyström landmarks are strings that mark
labelled toxic sentences; a word's features are its kernel values with them, whitened by the landmarks' own kernel, and
a linear SVM trained on words of labelled sentences gives it a margin. A text's score is the logistic of its largest
margin over words and over runs of spaced-out letters. Distinct words are scored once a task, in a cache of bounded
size. Null and empty texts score as a text without signs. Training reads a bounded sample of labelled rows and of their
words, as fit() says; every text is scored whole. A column named score is replaced, others stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, text_batches

P, DECAY, LONGEST, LANDMARKS, MAX_LABELLED, MAX_WORDS, CACHE_WORDS = 3, 0.5, 24, 32, 6000, 10_000, 400_000
WORD = re.compile(r"[^\W_]+(?:[.\-_*'][^\W_]+)*")


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Gap-weighted subsequence kernel of length P of each word with each landmark, divided by the landmarks' own norm
    only: a long word that holds an insult is as near to it as the bare insult. Weights are DECAY to the gaps' length."""
    n, t = max(map(len, words)), max(map(len, landmarks))
    a = np.zeros((len(words), 1, n), np.int32)
    b = np.full((1, len(landmarks), t), -1, np.int32)
    for i, w in enumerate(words):
        a[i, 0, : len(w)] = [ord(c) for c in w]
    for j, w in enumerate(landmarks):
        b[0, j, : len(w)] = [ord(c) for c in w]
    # over[k, j]: what a run that ends at k of the landmark weighs for a character at j
    over = np.triu(DECAY ** (np.arange(t)[None, :] - np.arange(t)[:, None] - 1.0), 1).astype(np.float32)
    same = [(a[:, :, i, None] == b).astype(np.float32) for i in range(n)]  # words x landmarks x t
    ends = same
    for _ in range(P - 1):
        longer, run = [], np.zeros((len(words), len(landmarks), t), np.float32)  # weights of shorter ones before i
        for i in range(n):
            longer.append(same[i] * (run @ over))
            run *= DECAY
            run += ends[i]
        ends = longer
    return np.add.reduce(ends).sum(axis=2)


def features(words: list[str], landmarks: list[str]) -> np.ndarray:
    return kernel(words, landmarks) / np.array([kernel([w], [w])[0, 0] + 1e-6 for w in landmarks])


class Machine:
    """Landmarks, whitening and a linear SVM in one weight for each landmark."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float):
        self.landmarks, self.weights, self.bias = landmarks, weights, bias
        self.own = np.array([kernel([w], [w])[0, 0] + 1e-6 for w in landmarks])

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words), np.float32)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for s in range(0, len(order), 256):
            part = order[s : s + 256]
            out[part] = kernel([words[i] for i in part], self.landmarks) / self.own @ self.weights + self.bias
        return out


def units(text: str | None) -> set[str]:
    """Lower-case words without signs inside, and runs of single letters joined; long ones in overlapping windows."""
    found = [w for w in WORD.findall((text or "").lower())]
    out, run = set(), []
    for w in [*found, ""]:
        if len(w) == 1:
            run.append(w)
            continue
        if len(run) >= 4:
            out.update(_windows("".join(run)))
        run = []
        if len(w) >= 4:
            out.update(_windows(re.sub(r"[.\-_*']", "", w)))
    return out


def _windows(w: str) -> list[str]:
    return [w] if len(w) <= LONGEST else [w[i : i + LONGEST] for i in range(0, len(w) - LONGEST // 2, LONGEST // 2)]


def _signs(texts: list[tuple[tuple[str, ...], int]]) -> tuple[list[str], Counter, Counter]:
    """Word beginnings that mark toxic texts, and words' counts: each adds the most texts to those already covered, and
    stands in hardly any clean one."""
    bad, good = Counter(), Counter()
    for words, toxic in texts:
        (bad if toxic else good).update(words)
    starts = Counter()
    for words, toxic in texts:
        if toxic:
            starts.update({w[:k] for w in words if w not in good for k in range(4, min(10, len(w)) + 1)})
    clean = Counter({s: 0 for s, c in starts.items() if c >= 3})
    for w, c in good.items():
        for k in range(4, min(10, len(w)) + 1):
            if w[:k] in clean:
                clean[w[:k]] += c
    found: dict[str, set[int]] = {s: set() for s, c in clean.items() if c <= 0.02 * starts[s]}
    for i, (words, toxic) in enumerate(texts):
        if toxic:
            for w in words:
                if w not in good:
                    for k in range(4, min(10, len(w)) + 1):
                        if w[:k] in found:
                            found[w[:k]].add(i)
    least = max(3, round(0.002 * sum(y for _, y in texts)))
    picked: list[str] = []
    for _ in range(LANDMARKS):
        if not found:
            break
        best = max(found, key=lambda s: (len(found[s]), len(s), s))
        if len(found[best]) < least:
            break
        same = found.pop(best)
        picked.append(best)
        found = {s: d for s, d in ((s, d - same if s.startswith(best) or best.startswith(s) else d) for s, d in found.items()) if len(d) >= least}
    return picked, bad, good


def train(rows: list[tuple[str | None, int]], max_words: int = MAX_WORDS) -> Machine:
    """From labelled texts, without a cut between texts: see cut(). Without both labels, a machine that finds nothing. The
    machine learns from max_words words at most: two fifths of them toxic, three tenths clean ones nearest to a landmark
    (of twice max_words drawn), the rest clean ones drawn from all."""
    once: dict[str, str] = {}  # one string for each distinct word: the driver's memory
    texts = [(tuple(once.setdefault(w, w) for w in units(t)), y) for t, y in rows]
    once.clear()
    landmarks, bad, good = _signs(texts)
    if not landmarks or not good:
        return Machine(["none"], np.zeros(1, np.float32), -1.0)
    rng = np.random.default_rng(7)
    positive = sorted({w for w in bad if any(s in w for s in landmarks)})
    positive = [positive[i] for i in rng.permutation(len(positive))[: 2 * max_words // 5]]
    clean = sorted(w for w in good if not any(s in w for s in landmarks))
    negative = sorted({*features_top(clean, landmarks, 3 * max_words // 10, 2 * max_words), *(clean[i] for i in rng.permutation(len(clean))[: 3 * max_words // 10])})
    hidden = [w[: len(w) // 2] + c + w[len(w) // 2 :] for w in landmarks if len(w) > 4 for c in "xq"]  # an inserted character
    words = [*positive, *landmarks, *hidden, *negative]
    y = np.array([1.0] * (len(words) - len(negative)) + [-1.0] * len(negative))
    x = np.concatenate([features(words[i : i + 256], landmarks) for i in range(0, len(words), 256)]).astype(np.float64)
    gram = kernel(landmarks, landmarks)
    own = np.sqrt(np.diag(gram) + 1e-6)
    value, vector = np.linalg.eigh(gram / own / own[:, None])
    white = own[:, None] * vector / np.sqrt(np.maximum(value, 1e-2))  # features times own, by the gram's inverse root
    z = np.hstack([x @ white, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(40):  # squared hinge loss: least squares over the rows inside the margin, until they stay the same
        inside = y * (z @ w) < 1
        part = z[inside]
        new = np.linalg.solve(part.T @ part + 1e-2 * np.eye(z.shape[1]), part.T @ y[inside])
        if np.allclose(new, w):
            break
        w = new
    machine = Machine(landmarks, (white @ w[:-1]).astype(np.float32), float(w[-1]))
    return machine


def cut(machine: Machine, margins: list[tuple[float, int]]) -> Machine:
    """Moves the machine's bias to where fewest texts of (largest margin, label) are wrong, halfway between two of them."""
    most = sorted(margins)
    if not most or len({y for _, y in most}) < 2:
        return machine
    errors = best = sum(not y for _, y in most)  # a threshold below all: every clean text is wrong
    at = most[0][0] - 1
    for (m, label), (after, _) in zip(most, [*most[1:], (most[-1][0] + 1, 0)]):
        errors += 1 if label else -1
        if errors < best and after > m:
            best, at = errors, (m + after) / 2
    machine.bias -= at
    return machine


def features_top(words: list[str], landmarks: list[str], n: int, drawn: int) -> list[str]:
    """The n clean words nearest to any landmark, of drawn ones: hard negatives."""
    words = [words[i] for i in np.random.default_rng(5).permutation(len(words))[:drawn]]
    best = np.concatenate([features(words[i : i + 512], landmarks).max(axis=1) for i in range(0, len(words), 512)]) if words else np.empty(0)
    return [words[i] for i in np.argsort(-best)[:n]]


def fit(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, max_words: int = MAX_WORDS) -> Machine:
    """Learns from labelled rows that aren't held out: max_labelled clean ones and a third as many toxic ones at most, drawn
    by hash of the id; an id with both labels is toxic. Texts of all drawn rows set the cut between texts."""
    ids = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    ids = ids.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = ids.where("toxic = 1").orderBy(F.xxhash64("doc_id")).limit(max_labelled // 3).unionByName(ids.where("toxic = 0").orderBy(F.xxhash64("doc_id")).limit(max_labelled))
    rows = materialize(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "labelled")
    machine = train([(r[0], r[1]) for r in rows.orderBy("doc_id").select("text", "toxic").collect()], max_words)
    margins = rows.select("text", "toxic").mapInArrow(_margins(machine), "margin double, toxic int").collect()
    return cut(machine, [(r[0], r[1]) for r in margins])


def _margins(machine: Machine):
    """The largest margin of each row's text, and its label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [units(t) for t in batch.column(0).to_pylist()]
            new = sorted(set().union(*texts))
            margin = dict(zip(new, machine.margins(new).tolist() if new else ()))
            yield pa.RecordBatch.from_arrays([pa.array([max((margin[w] for w in t), default=-1.0) for t in texts], pa.float64()), batch.column(1)], names=["margin", "toxic"])

    return run


def held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1)."""
    text_batches(docs.sparkSession)
    schema = docs.drop("score").schema
    names, at = schema.fieldNames(), schema.fieldNames().index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [units(t) for t in part.column(at).to_pylist()]
                new = sorted(set().union(*texts) - cache.keys())
                if len(cache) + len(new) > CACHE_WORDS:
                    cache.clear()
                    new = sorted(set().union(*texts))
                cache.update(zip(new, machine.margins(new).tolist() if new else ()))
                best = [max((cache[w] for w in t), default=min(-1.0, machine.bias)) for t in texts]
                scores = [1 / (1 + float(np.exp(-4 * min(20.0, max(-20.0, m))))) for m in best]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*names, "score"])

    return docs.drop("score").mapInArrow(run, schema.add("score", "double"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = fit(docs, table(spark, sf_dir, "labels"))
    out = score(docs, machine)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
