"""Line dedup by fingerprints of line runs; DataFrame functions only.

The shortest runs that count are three lines, of any length, and one or two lines of over WORDS words. Every such run
has a hash (64 bits) as its fingerprint, and each place of a fingerprint but its first (by doc_id, text, position) is
deleted. A longer repeated run consists of these, so matches extend as far as lines are equal, whatever stands first
for each part. Winnowing keeps all fingerprints here, as none is shorter than the shortest match. Runs are judged on the
input. Words are runs of signs other than white space. Documents of equal doc_id and text are one document; null ids
come last; a null text has no lines and stays null. Extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

LAST, LINES, WORDS = (1 << 63) - 1, 3, 50


def _fingerprints(lines: Column) -> Column:
    """Fingerprint, position and number of lines of each shortest run; lines: hash h and words w of each line."""
    size = F.size(lines)

    def runs(n: int) -> Column:
        places = F.when(size >= n, F.sequence(F.lit(0), size - n)).otherwise(F.array().cast("array<int>"))
        if n < LINES:
            places = F.filter(places, lambda i: sum((F.get(lines, i + j)["w"] for j in range(1, n)), F.get(lines, i)["w"]) > WORDS)
        return F.transform(places, lambda i: F.struct(F.xxhash64(F.lit(n), *[F.get(lines, i + j)["h"] for j in range(n)]).alias("fp"), i.alias("pos"), F.lit(n).alias("n")))

    return F.concat(*[runs(n) for n in range(1, LINES + 1)])


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each document with lines to delete: k (id), t (hash of the text) and gone (their positions, from 0)."""
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("k"), F.xxhash64(text_col).alias("t")]
    lines = F.transform(F.split(F.col(text_col), "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(r"\S+")).alias("w")))
    base = materialize(docs.select(*key, lines.alias("lines")).where(F.col(text_col).isNotNull()).dropDuplicates(["k", "t"]), "lines")
    marks = base.select("k", "t", F.explode(_fingerprints(F.col("lines"))).alias("m")).select("k", "t", "m.fp", "m.pos", "m.n")
    first = marks.groupBy("fp").agg(F.min(F.struct("k", "t", "pos")).alias("f"), F.count("*").alias("places")).where("places > 1").drop("places")
    later = marks.join(first, "fp").where(F.struct("k", "t", "pos") > F.col("f"))
    runs = later.groupBy("k", "t").agg(F.collect_list(F.sequence("pos", F.col("pos") + F.col("n") - 1)).alias("runs"))
    return runs.select("k", "t", F.array_distinct(F.flatten("runs")).alias("gone"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the later repeated runs deleted from text_col; n_lines and n_removed are added."""
    gone = repeated_lines(docs, id_col, text_col)
    keyed = docs.withColumns({"_k": F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), "_t": F.xxhash64(text_col)})
    out = keyed.join(gone.withColumnsRenamed({"k": "_k", "t": "_t", "gone": "_gone"}), ["_k", "_t"], "left")
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_gone", i)), "\n")
    counts = {"n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"), "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")}
    counts["n_lines"] = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long")
    counts["n_removed"] = F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long")
    return out.withColumns(counts | {text_col: F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(kept)}).drop("_k", "_t", "_gone")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
