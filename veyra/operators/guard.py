"""Name guards, splits, manifests and set indices: checks on schemas run on the driver and start no job."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import average_ranks, counted, cumulate, dealt, join_on, quantiles
from .survey import auc, finite


class LeakageError(ValueError):
    """A design matrix holds a column that its outcome could leak through."""


#: What forbidden names are, marks of derived columns, and why a column is forbidden.
FORBIDDEN = (
    "PV\\d+MATH", "PV\\d+READ", "PV\\d+SCIE", "PV\\d+[A-Z]+\\d*", "math_score", "math_category", "label", "proficiency.*", "MATH", "READ", "SCIE",
    "W_FST.*", "W_SCH.*", "SENWT", "STRATUM.*", "VER_.*", "CNTSCHID", "CNTSTUID", "CNTRYID", "CNT", "CYC", "NatCen", "SUBNATIO", "OECD",
    "ADMINMODE", "LANGTEST", "BOOKID", "Region", "Unnamed.*", "^\\s*$", "NOISE_CONTROL",
    "ESCS", "HISEI", "HISCED", "PARED", "MISCED", "FISCED", "BSMJ", "WEALTH", "HOMEPOS", "CULTPOSS", "HEDRES", "ICTRES",
)
PREFIXES = ("MISSINGINDICATOR_", "LOG_", "SQRT_", "Z_", "STD_", "SCALED_", "NORM_", "IMPUTED_", "BINNED_", "RANK_", "PCT_")
SUFFIXES = ("_Z", "_STD", "_SCALED", "_NORM", "_MEAN", "_RANK", "_PCT", "_BIN", "_IMPUTED", "_LOG", "_CAT", "_QUANTILE")
REASONS = {"PV": "plausible value", "W_": "survey weight", "SENWT": "survey weight", "STRATUM": "sampling stratum", "CNTSCHID": "cluster of the folds", "CNT": "identifier", "math": "the outcome", "label": "the outcome", "NOISE": "noise for diagnosis", "ESCS": "composite behind the plausible values"}
#: Classes of columns in order of precedence: pattern (whole name), class, justification.
CLASSES = (
    ("math_score|math_category|label", "outcome", "the target or what it thresholds"),
    ("PV\\d+MATH", "outcome", "plausible value that the outcome thresholds"),
    ("PV\\d+[A-Z]+\\d*", "outcome-derived", "plausible value of the same model"),
    ("W_FST.*|W_SCH.*|SENWT", "design/weight", "survey weight"),
    ("STRATUM.*", "design/weight", "sampling stratum"),
    ("CNTSCHID|CNTSTUID|CNTRYID", "identifier", "unit"),
    ("CNT|CYC|NatCen|SUBNATIO|OECD|VER_.*|ADMINMODE|LANGTEST|BOOKID|Region", "identifier", "administrative"),
    ("noise_control", "negative-control", "injected noise"),
)


def forms(name: str, prefixes: Sequence[str] = PREFIXES, suffixes: Sequence[str] = SUFFIXES) -> list[str]:
    """The name without white space in upper case, and what is left without one known prefix, one known suffix or the last token."""
    whole = re.sub(r"\s+", "", str(name)).upper()
    out = [whole, *[whole.removeprefix(p) for p in prefixes if whole.startswith(p)], *[whole.removesuffix(s) for s in suffixes if whole.endswith(s)]]
    out.append(whole.rpartition("_")[0] if "_" in whole else whole)
    return list(dict.fromkeys(x for x in out if x))


def name_forms(name: Column, prefixes: Sequence[str] = PREFIXES, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """forms() as an array column, for tables of names."""
    whole = F.upper(F.regexp_replace(name, r"\s+", ""))
    out = [whole, *[F.when(whole.startswith(p), F.substring(whole, len(p) + 1, 1 << 20)) for p in prefixes], *[F.when(whole.endswith(s), F.regexp_replace(whole, re.escape(s) + "$", "")) for s in suffixes], F.regexp_replace(whole, "_[^_]*$", "")]
    return F.filter(F.array_distinct(F.array_compact(F.array(*out))), lambda f: f != "")


def forbidden(columns: Iterable[str], patterns: Sequence[str] = FORBIDDEN, prefixes: Sequence[str] = PREFIXES, suffixes: Sequence[str] = SUFFIXES) -> dict[str, tuple[str, str]]:
    """Forbidden columns with the form and pattern that match first: forms in the order of forms(), then patterns."""
    compiled = [(p, re.compile(p, re.IGNORECASE)) for p in patterns]
    return {c: hit for c in columns for hit in [next(((f, p) for f in forms(c, prefixes, suffixes) for p, r in compiled if r.fullmatch(f)), None)] if hit}


def forbidden_names(names: DataFrame, column: str, patterns: Sequence[str] = FORBIDDEN) -> DataFrame:
    """Rows of a table of names whose name or a derived form of it is forbidden, with the pattern: the first that any form
    matches. Each name is looked at once, however many rows have it, and its forms are made once for all patterns."""
    each = names.select(column).distinct().select(column, F.explode(name_forms(F.col(column))).alias("_form"))
    at = F.coalesce(*[F.when(F.col("_form").rlike(f"(?i)^(?:{p})$"), i) for i, p in enumerate(patterns)])
    hits = each.groupBy(column).agg(F.min(at).alias("_at")).where(F.col("_at").isNotNull())
    return names.join(hits, column).select(*names.columns, F.element_at(F.array(*map(F.lit, patterns)), F.col("_at") + 1).alias("pattern"))


def reason(column: str, hit: tuple[str, str]) -> str:
    form, pattern = hit
    why = next((v for k, v in REASONS.items() if pattern.upper().startswith(k.upper())), f"matches {pattern}")
    return why + (f" (derived form of {form})" if form != forms(column)[0] else "")


def assert_no_leakage(columns: Iterable[str] | DataFrame, patterns: Sequence[str] = FORBIDDEN, where: str = "", prefixes: Sequence[str] = PREFIXES, suffixes: Sequence[str] = SUFFIXES) -> None:
    """Raises where a column is forbidden; names are needed, a matrix without any is refused."""
    names = getattr(columns, "columns", columns)
    names = [None] if names is None else list(names)
    if not all(isinstance(c, str) for c in names):
        raise ValueError(f"{where}: columns without names can't be checked")
    if found := forbidden(names, patterns, prefixes, suffixes):
        raise LeakageError(f"{where}: {len(found)} forbidden columns: " + "; ".join(f"{c} ({reason(c, h)})" for c, h in list(found.items())[:40]))


def classify_columns(names: DataFrame, column: str) -> DataFrame:
    """Adds classification and justification to a table of names: the first class whose pattern is the whole name."""
    kind, why = F, F
    for i, (p, c, j) in enumerate(CLASSES):
        hit = F.col(column).rlike(f"^(?:{p})$")
        kind, why = (kind.when(hit, c), why.when(hit, j)) if i else (F.when(hit, c), F.when(hit, j))
    return names.withColumns({"classification": kind.otherwise("candidate predictor"), "justification": why.otherwise("item; admissible if allow-listed")})


def expand(wanted: Iterable[str], columns: Sequence[str]) -> list[str]:
    """Each name, or else all columns that begin with it and a sign _; without repeats, in order."""
    return list(dict.fromkeys(c for n in wanted for c in ([n] if n in columns else [c for c in columns if c.startswith(f"{n}_")])))


class Allowlist:
    """Candidate predictors, each with its reason; entries: name to block, label, scale, justification and so on."""

    FIELDS = ("block", "label", "scale", "justification", "source", "encoding", "single_auc", "signed_off_by")

    def __init__(self, entries: Mapping[str, Mapping], meta: Mapping | None = None):
        defaults = {"source": "student_questionnaire", "encoding": "ordinal", "single_auc": None, "signed_off_by": None}
        self.entries = {n: {f: e.get(f, defaults.get(f, "")) for f in self.FIELDS} for n, e in entries.items()}
        self.meta = dict(meta or {})
        if bad := forbidden(self.entries):
            raise LeakageError(f"allow-listed and forbidden: {sorted(bad)}")
        if bare := sorted(n for n, e in self.entries.items() if not str(e["justification"] or "").strip()):
            raise ValueError(f"allow-listed without justification: {bare}")

    @classmethod
    def load(cls, path: str) -> Allowlist:
        from veyra.sources.tables import load_yaml

        doc = load_yaml(path)
        return cls(doc.get("predictors") or {}, doc.get("meta"))

    @property
    def names(self) -> list[str]:
        return list(self.entries)

    @property
    def signed_off(self) -> set[str]:
        return {n for n, e in self.entries.items() if e["signed_off_by"]}

    def expand(self, columns: Sequence[str]) -> list[str]:
        return expand(self.names, columns)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        kinds = ", ".join(f"{f} {'double' if f == 'single_auc' else 'string'}" for f in self.FIELDS)
        return spark.createDataFrame([(n, *[e[f] for f in self.FIELDS]) for n, e in self.entries.items()], f"name string, {kinds}")


def design_matrix(df: DataFrame, wanted: Sequence[str] | Allowlist, patterns: Sequence[str] = FORBIDDEN, strict: bool = True, noise_seed: int | None = None) -> DataFrame:
    """Allow-listed columns as doubles, NULL where a value isn't a number. noise_seed appends noise_control, standard
    normal noise, after the check of names."""
    names = list(getattr(wanted, "names", wanted))
    if strict and (gone := [n for n in names if not expand([n], df.columns)]):
        raise KeyError(f"not in the table: {gone}")
    picked = expand(names, df.columns)
    assert_no_leakage(picked, patterns, "design_matrix")
    out = df.select(*[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in picked])
    return out if noise_seed is None else out.withColumn("noise_control", F.randn(noise_seed))


def single_variable_screen(long: DataFrame, label: str, *, ceiling: float = 0.95, signed_off: Iterable[str] = (), raise_on_flag: bool = True) -> DataFrame:
    """Of a long table (feature, value): auc in either direction, auc_signed, n_used, flagged; highest first. Fewer than ten
    rows, one class or one value give NULL. Features above the ceiling that nobody signed off raise."""
    rows = long.withColumn("value", finite(F.col("value"))).where(F.col("value").isNotNull() & F.col(label).isNotNull())
    facts = rows.groupBy("feature").agg(F.count("*").alias("n_used"), (F.min(label) < F.max(label)).alias("_two"), (F.min("value") < F.max("value")).alias("_varies"))
    facts = long.select("feature").distinct().join(facts, "feature", "left").join(auc(rows, ["feature"], label, "value").withColumnRenamed("auc", "_a"), "feature", "left")
    sound = F.coalesce((F.col("n_used") >= 10) & F.col("_two") & F.col("_varies"), F.lit(False))
    out = facts.select("feature", F.when(sound, F.greatest("_a", 1 - F.col("_a"))).alias("auc"), F.when(sound, F.col("_a")).alias("auc_signed"), F.coalesce("n_used", F.lit(0)).alias("n_used"))
    out = out.withColumns({"flagged": F.coalesce(F.col("auc") > ceiling, F.lit(False)), "ceiling": F.lit(ceiling)}).orderBy(F.desc_nulls_last("auc"), "feature")
    if raise_on_flag and (bad := [r[0] for r in out.where("flagged").select("feature").collect() if r[0] not in set(signed_off)]):
        raise LeakageError(f"features that separate the classes above {ceiling} on their own: {bad}")
    return out


def hash_folds(df: DataFrame, cluster: str, folds: int, seed: int = 0) -> DataFrame:
    """A fold for each row; a cluster is never split."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), cluster), F.lit(folds)).cast("int"))


def greedy_folds(df: DataFrame, cluster: str, label: str, folds: int, *, seed: int | None = None, stratified: bool = True) -> DataFrame:
    """(cluster, fold): clusters by falling spread of class counts go to the fold where class shares stay nearest; without
    stratified, by falling size to the smallest fold. seed settles clusters of equal spread, which else go by name.

    Counts of each cluster come to the driver: there are few clusters by design; use hash_folds for many."""
    counts = {r[0]: (r[1], r[2]) for r in df.groupBy(cluster).agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).collect()}
    if len(counts) < folds:
        raise ValueError(f"{len(counts)} clusters can't make {folds} folds")
    load = [[0, 0] for _ in range(folds)]
    total = [max(1, sum(c[k] for c in counts.values())) for k in (0, 1)]
    rank = {g: i if seed is None else hashlib.md5(f"{seed}|{g}".encode()).hexdigest() for i, g in enumerate(sorted(counts, key=str))}
    size = lambda c: (-abs(c[0] - c[1]), -sum(c)) if stratified else (-sum(c),)
    placed = []
    for g, c in sorted(counts.items(), key=lambda x: (size(x[1]), rank[x[0]])):
        def spread(f: int, c=c) -> float:
            new = [[(load[i][k] + (c[k] if i == f else 0)) / total[k] for i in range(folds)] for k in (0, 1)]
            return sum(sum((x - sum(v) / folds) ** 2 for x in v) for v in new)

        best = min(range(folds), key=lambda f: ((spread(f) if stratified else 0.0), sum(load[f]), f))
        load[best] = [load[best][k] + c[k] for k in (0, 1)]
        placed.append((g, best))
    kind = df.schema[cluster].dataType.simpleString()
    return df.sparkSession.createDataFrame(placed, f"`{cluster}` {kind}, fold int")


def shared_clusters(train: DataFrame, test: DataFrame, cluster: str) -> DataFrame:
    """Clusters that stand in both parts."""
    return train.select(cluster).distinct().join(test.select(cluster).distinct(), cluster, "left_semi")


def assert_disjoint(train: DataFrame, test: DataFrame, cluster: str) -> None:
    if shared := shared_clusters(train, test, cluster).limit(5).collect():
        raise ValueError(f"clusters in both parts: {[r[0] for r in shared]}")


def places(df: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """df with each row's place (_i) in its group by hash of key: what permute_within needs of a table, whatever the seed and
    label. Worth keeping for several permutations of one table."""
    return dealt(df, by, F.col(key), 0, "_i")


def permute_within(df: DataFrame, by: Sequence[str], label: str, key: str, seed: int, placed: DataFrame | None = None) -> DataFrame:
    """Labels dealt anew inside each group (everywhere without by); what a group holds stays. key tells rows apart, so the
    same seed gives the same labels however the table is partitioned. placed is places(df, by, key), if there is one."""
    a = places(df, by, key) if placed is None else placed
    source = df if placed is None else placed
    b = dealt(source.select(*by, F.col(label).alias("_l"), F.col(key).alias("_k")), by, F.col("_k"), seed + 1, "_i").drop("_k")
    met = join_on(a.drop(label), b, [*by, "_i"]) if by else a.drop(label).join(b, "_i")
    return met.withColumnRenamed("_l", label).drop("_i")


def jackknife_auc(df: DataFrame, cluster: str, label: str, score: str) -> DataFrame:
    """AUC without each cluster, from cumulative counts: no cluster is scanned again."""
    cells = df.groupBy(cluster, F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).cast("double").alias("p"), F.count_if(F.col(label) == 0).cast("double").alias("n"))
    every = cumulate(cells.groupBy("s").agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n")), [], "s", ["all_p", "all_n"])
    every = every.select("s", "all_p", "all_n", (F.col("below_all_n") + F.col("all_n") / 2).alias("below_n"), (F.col("below_all_p") + F.col("all_p") / 2).alias("below_p"))
    total = every.agg(F.sum("all_p").alias("sum_p"), F.sum("all_n").alias("sum_n"), F.sum(F.col("all_p") * F.col("below_n")).alias("u"))
    own = cumulate(cells, [cluster], "s", ["n"]).withColumn("own_n", F.col("below_n") + F.col("n") / 2).drop("below_n")
    mine = own.join(every, "s").crossJoin(F.broadcast(total))
    g = mine.groupBy(cluster, "sum_p", "sum_n", "u").agg(F.sum("p").alias("gp"), F.sum("n").alias("gn"), F.sum(F.col("p") * F.col("below_n")).alias("up"), F.sum(F.col("n") * (F.col("sum_p") - F.col("below_p"))).alias("un"), F.sum(F.col("p") * F.col("own_n")).alias("ug"))
    return g.select(cluster, F.try_divide(F.col("u") - F.col("up") - F.col("un") + F.col("ug"), (F.col("sum_p") - F.col("gp")) * (F.col("sum_n") - F.col("gn"))).alias("auc"))


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson of average ranks."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_a"), F.col(y).alias("_b"))
    return average_ranks(average_ranks(both, by, "_a", "_x"), by, "_b", "_y").groupBy(*by).agg(F.corr("_x", "_y").alias("rho"))


class Preparation:
    """Medians, means and SDs of a training table, to prepare it and any other table alike: missing values become the
    median, features that have any get an indicator, then everything is (x - mean) / population SD (SD 0: 1)."""

    def __init__(self, df: DataFrame, features: Sequence[str], *, scale: bool = True, indicators: bool = True):
        long = df.unpivot([], [finite(F.col(f"`{f}`").cast("double")).alias(f) for f in features], "feature", "value")
        gaps = {r[0]: r[1] for r in long.groupBy("feature").agg(F.count_if(F.col("value").isNull())).collect()}
        cells = counted(long, ["feature"], "value")
        self.medians = {f: 0.0 for f in features} | {r[0]: r[1][0] for r in quantiles(cells, ["feature"], "value", [0.5]).collect()}
        self.features, self.flagged = list(features), [f for f in features if indicators and gaps.get(f)]
        self.names = [*features, *[f"missingindicator_{f}" for f in self.flagged]]
        self.moments = {c: (0.0, 1.0) for c in self.names}
        if scale:
            m = self._filled(df).agg(*[g(f"`{c}`").alias(f"{c}|{k}") for c in self.names for k, g in (("avg", F.avg), ("sd", F.stddev_pop))]).first()
            self.moments = {c: (m[f"{c}|avg"] or 0.0, m[f"{c}|sd"] or 1.0) for c in self.names}

    def _filled(self, df: DataFrame) -> DataFrame:
        value = {f: finite(F.col(f"`{f}`").cast("double")) for f in self.features}
        flags = {f"missingindicator_{f}": value[f].isNull().cast("double") for f in self.flagged}
        return df.withColumns(flags | {f: F.coalesce(value[f], F.lit(self.medians[f])) for f in self.features})

    def apply(self, df: DataFrame) -> DataFrame:
        return self._filled(df).withColumns({c: (F.col(f"`{c}`") - m) / s for c, (m, s) in self.moments.items()})


def impute_and_scale(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Preparation of a table by itself."""
    return Preparation(df, features).apply(df)
