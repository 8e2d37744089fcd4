"""A corpus pipeline of five stages, each over all that its predecessor kept.

Stages take documents with any further columns and return COLUMNS; the last returns digests. Null and empty texts pass
every stage (no signs, no lines, no shingles, no words, no tokens) and null ids stay, as documents of their own where
texts differ; rows of one id are one document for near-dedup, which keeps one of them. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veyra.llm import bpe, decontaminate, lines, neardup, toxicity
from veyra.llm.common import shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay."""
    machine = toxicity.fit(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), machine).where("score < 0.5").select(*COLUMNS)


def lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose later repeated runs of lines; a document left without text goes."""
    out = lines.dedup(docs.select(*COLUMNS)).where("n_removed = 0 or length(trim(text)) > 0")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies stays, as one row: of rows with that id, the one
    with the least hash of its text. Rows without id take part under an id made of their text's hash, after all others."""
    h = F.xxhash64("text")
    keyed = docs.select(*COLUMNS).withColumns({"_h": h, "_k": F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(h, 2) + F.lit(1 << 62))})
    heads = neardup.cluster(keyed, id_col="_k").where("doc_id = component_id").select(F.col("doc_id").alias("_k")).distinct()
    rows = keyed.groupBy("_k").agg(F.min("_h").alias("_h")).join(heads, "_k")
    return keyed.join(rows, ["_k", "_h"], "left_semi").dropDuplicates(["_k", "_h"]).select(*COLUMNS)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold benchmark text as long as a window, however long they are, or a twentieth of which is such text."""
    found = decontaminate.find(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return decontaminate.contaminated(found).where(~decontaminate.leaked()).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and the texts decoded again, as digests."""
    import public_tokenizers

    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.selectExpr("doc_id", "n_tokens", "sha2(ids, 256) ids_sha256", "sha2(decoded, 256) decoded_sha256")


STAGES = [("toxicity", toxic_out), ("line dedup", lines_out), ("near-dedup", near_out), ("decontamination", leaks_out), ("tokens", tokens)]
#: Training and near-duplicate search are not SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = shared_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{k}")
    return docs
