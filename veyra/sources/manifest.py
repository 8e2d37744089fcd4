"""What files a result folder holds, by digest, and how two such lists differ."""

from __future__ import annotations

import subprocess
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_digests(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256, bytes) of all files below root but manifest.json, paths relative to it. Files are read in tasks, each
    whole: meant for results, not for raw data."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    prefix = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/") + "/"
    path = F.substring(F.regexp_replace("path", "^(file|hdfs|viewfs):/+", "$1:/"), len(prefix.replace("://", ":/").replace("//", "/")) + 1, 1 << 20)
    return files.select(path.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")).where("path <> 'manifest.json'").orderBy("path")


def git_commit(folder: str = ".") -> str | None:
    try:
        return subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, check=True, timeout=10).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def build_manifest(spark: SparkSession, root: str, **facts) -> dict:
    files = {r["path"]: {"sha256": r["sha256"], "bytes": r["bytes"]} for r in file_digests(spark, root).collect()}
    return {"created": datetime.now(UTC).isoformat(), "commit": git_commit(), "n_files": len(files), "files": files, **facts}


def write_manifest(spark: SparkSession, root: str, **facts) -> dict:
    """Writes manifest.json into root through Hadoop's file system."""
    import json

    made = build_manifest(spark, root, **facts)
    jvm, p = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/manifest.json")
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    jvm.org.apache.commons.io.IOUtils.write(json.dumps(made, indent=1, sort_keys=True), out, "UTF-8")
    out.close()
    return made


def compare(a: DataFrame, b: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """(key, status) with status same, differing, only_a or only_b: one full outer join."""
    x, y = a.select(F.col(key).alias("_k"), F.col(digest).alias("_x"), F.lit(True).alias("_a")), b.select(key, F.col(digest).alias("_y"), F.lit(True).alias("_b"))
    both = x.join(y, F.col("_k") == F.col(key), "full")
    status = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(F.col("_x").eqNullSafe(F.col("_y")), "same").otherwise("differing")
    return both.select(F.coalesce("_k", key).alias(key), status.alias("status"))


def summary(compared: DataFrame) -> DataFrame:
    """common, differing, only_a, only_b in one row."""
    return compared.agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("same", "common"), ("differing", "differing"), ("only_a", "only_a"), ("only_b", "only_b"))])
