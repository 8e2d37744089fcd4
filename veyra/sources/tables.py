"""Tables in and out: readers by format, the analytic extract, fold stores and report sinks."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, StringType, StructType
from pyspark.sql.utils import AnalysisException

from veyra.operators.survey import missing_count


def load_yaml(path: str) -> dict:
    import yaml

    with open(path) as f:
        return yaml.safe_load(f) or {}


def exists(spark: SparkSession, path: str) -> bool:
    """Through the session's own file systems."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def require(spark: SparkSession, path: str, hint: str = "") -> str:
    if not exists(spark, path):
        raise FileNotFoundError(f"{path} isn't there. {hint or 'Put the raw table there, or name another path.'}")
    return path


class SpssSource(DataSource):
    """SPSS files ("spss"), where pyreadstat can be imported: partitions are ranges of rows, and only the schema's columns
    are read. Options: path, rows_per_partition."""

    @classmethod
    def name(cls) -> str:
        return "spss"

    def schema(self) -> StructType:
        kinds = _pyreadstat().read_sav(self.options["path"], metadataonly=True)[1].readstat_variable_types
        out = StructType()
        for name, kind in kinds.items():
            out = out.add(name, StringType() if kind == "string" else DoubleType())
        return out

    def reader(self, schema: StructType) -> SpssReader:
        return SpssReader(self.options, schema)


class Rows(InputPartition):
    def __init__(self, offset: int, limit: int):
        self.offset, self.limit = offset, limit


class SpssReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.step, self.columns = options["path"], int(options.get("rows_per_partition", 100_000)), schema.fieldNames()

    def partitions(self) -> list[Rows]:
        n = _pyreadstat().read_sav(self.path, metadataonly=True)[1].number_rows
        return [Rows(at, min(self.step, n - at)) for at in range(0, n, self.step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        frame = _pyreadstat().read_sav(self.path, usecols=self.columns, row_offset=partition.offset, row_limit=partition.limit)[0]
        for row in frame[self.columns].itertuples(index=False):
            yield tuple(None if isinstance(v, float) and math.isnan(v) else v for v in row)


def _pyreadstat():
    try:
        import pyreadstat
    except ImportError as e:
        raise ImportError("SPSS files need the package pyreadstat on the driver and all executors; or convert them to Parquet or CSV") from e
    return pyreadstat


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet, CSV, JSON lines or SPSS by the path's ending; Parquet where there is none."""
    end = path.rstrip("/").rpartition(".")[2].lower()
    if end == "csv":
        out = spark.read.option("header", True).option("inferSchema", True).csv(path)
    elif end in ("json", "jsonl"):
        out = spark.read.json(path)
    elif end in ("sav", "zsav"):
        spark.dataSource.register(SpssSource)
        out = spark.read.format("spss").load(path)
    else:
        out = spark.read.parquet(path)
    return out.select(*[F.col(f"`{c}`") for c in columns]) if columns else out


def analytic_frame(source: DataFrame, country: str, countries: Sequence[str]) -> DataFrame:
    """Rows of the countries, with n_missing_allcols: how many of all columns are NULL or NaN. The filter and the columns
    that a query needs reach the scan."""
    rows = source.where(F.col(country).isin(*dict.fromkeys(countries)))
    return rows.withColumn("n_missing_allcols", missing_count(source.columns, dict(source.dtypes)).cast("int"))


def read_through(spark: SparkSession, path: str, make, force: bool = False) -> DataFrame:
    """The table at path; written there first by make() where there is none, or by force. A table half written isn't taken."""
    if force or not exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def verification_extract(source: DataFrame, wanted: Sequence[str], country: str, countries: Sequence[str], path: str, *, fmt: str = "parquet", labels: dict | None = None) -> dict:
    """Writes the wanted columns that are there, for the countries, to path in one of parquet and csv, and tells which are
    absent and what labels are known: the sidecar, also written as JSON beside it."""
    present = [c for c in dict.fromkeys(wanted) if c in source.columns]
    rows = source.where(F.col(country).isin(*countries)).select(*[F.col(f"`{c}`") for c in present])
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown format {fmt!r}")
    writer = rows.write.mode("overwrite")
    writer.parquet(path) if fmt == "parquet" else writer.option("header", True).csv(path)
    side = {"columns": present, "absent": [c for c in wanted if c not in source.columns], "countries": list(countries), "labels": {c: v for c, v in (labels or {}).items() if c in present}}
    source.sparkSession.createDataFrame([(json.dumps(side, sort_keys=True),)], "value string").write.mode("overwrite").text(f"{path.rstrip('/')}_labels")
    return side


class FoldStore:
    """Rows of finished folds and their predictions, as Parquet in folders by fingerprint; a fold is there once its row is."""

    KEY = ("task", "pv", "method", "rep", "fold")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, mark: str, row: dict, predictions: DataFrame) -> None:
        key = "-".join(str(row[k]) for k in self.KEY)
        told = predictions.withColumns({k: F.lit(row[k]) for k in (*self.KEY, "threshold")})
        told.write.mode("overwrite").parquet(f"{self.path}/predictions/cfg={mark}/key={key}")
        line = self.spark.createDataFrame([(*[row[k] for k in self.KEY], json.dumps(row, sort_keys=True))], "task string, pv int, method string, rep int, fold int, row string")
        line.write.mode("overwrite").parquet(f"{self.path}/rows/cfg={mark}/key={key}")

    def _read(self, kind: str, mark: str | None) -> DataFrame | None:
        try:
            out = self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(f"{self.path}/{kind}/cfg=" + (mark or "*")).drop("key")
        except AnalysisException:
            return None
        return out if mark is None else out.drop("cfg")

    def rows(self, mark: str, **where) -> list[dict]:
        """Rows of the folds done under the fingerprint."""
        got = self._read("rows", mark)
        if got is None:
            return []
        for k, v in where.items():
            got = got.where(F.col(k) == v)
        return [json.loads(r["row"]) for r in got.orderBy("rep", "fold").select("row").collect()]

    def pending(self, mark: str, keys: DataFrame) -> DataFrame:
        """Keys (task, pv, method, rep, fold) that aren't done."""
        got = self._read("rows", mark)
        return keys if got is None else keys.join(got.select(*self.KEY), list(self.KEY), "left_anti")

    def predictions(self, mark: str | None = None) -> DataFrame:
        """The union of all predictions, of one fingerprint or of all (column cfg)."""
        got = self._read("predictions", mark)
        if got is None:
            raise FileNotFoundError(f"no predictions below {self.path}")
        return got


#: How TeX writes its own signs.
TEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def escape_tex(text) -> str:
    return "".join(TEX.get(c, c) for c in str(text))


def cell(value) -> str:
    """Four places for floating numbers, nothing for what is missing."""
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    return f"{value:.4f}" if isinstance(value, float) else str(value)


def to_latex(df: DataFrame, caption: str = "", label: str = "", most: int = 1000) -> str:
    """A result of at most most rows as a table; numbers stand right, signs _ of headings become spaces."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: this is a sink of reports")
    sides = "".join("r" if k in ("double", "float", "int", "bigint", "smallint") or k.startswith("decimal") else "l" for _, k in df.dtypes)
    lines = [" & ".join(escape_tex(c.replace("_", " ")) for c in df.columns), *[" & ".join(escape_tex(cell(v)) for v in r) for r in rows]]
    body = f"{lines[0]} \\\\\n\\midrule\n" + "".join(f"{line} \\\\\n" for line in lines[1:])
    out = f"\\begin{{tabular}}{{{sides}}}\n\\toprule\n{body}\\bottomrule\n\\end{{tabular}}\n"
    return f"\\begin{{table}}\n\\centering\n\\caption{{{escape_tex(caption)}}}\n\\label{{{label}}}\n{out}\\end{{table}}\n" if caption or label else out


def emit(df: DataFrame, name: str, folder: str, *, caption: str = "", most: int = 1000) -> dict[str, str]:
    """Writes folder/name.csv and folder/name.tex through Spark's writers; returns their paths."""
    spark, base = df.sparkSession, folder.rstrip("/")
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{base}/{name}.csv")
    spark.createDataFrame([(to_latex(df, caption, f"tab:{name}" if caption else "", most),)], "value string").write.mode("overwrite").text(f"{base}/{name}.tex")
    return {"csv": f"{base}/{name}.csv", "tex": f"{base}/{name}.tex"}


def stage_locally(path: str, folder: str, min_free_gb: float = 3.0) -> str:
    """A copy of a raw file in a folder of the driver's disk, for readers of single files on slow mounts; the path itself
    where too little would stay free. A copy of the same size is taken as it is."""
    import os
    import shutil

    size = os.path.getsize(path)
    target = os.path.join(folder, os.path.basename(path))
    if os.path.exists(target) and os.path.getsize(target) == size:
        return target
    os.makedirs(folder, exist_ok=True)
    if shutil.disk_usage(folder).free - size < min_free_gb * 1e9:
        return path
    part = f"{target}.part"
    shutil.copyfile(path, part)
    os.replace(part, target)
    return target
