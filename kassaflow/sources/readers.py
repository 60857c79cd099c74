"""Scans: Parquet tables, and directories of delimited files by table."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import COLUMNS, LOAD_ORDER, text_schema, typed


def parquet(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A Parquet table; zone-less times are read as timestamps of UTC.

    They are read as such, not cast afterwards, so ranges of times reach the scan.
    """
    path = f"{root}/{table}.parquet"
    df = spark.read.parquet(path)
    if not any(isinstance(f.dataType, T.TimestampNTZType) for f in df.schema):
        return df
    fields = [T.StructField(f.name, T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType, f.nullable) for f in df.schema]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def table_files(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """The delimited files below ``root`` by table, in order of name.

    A file belongs to the table that its name begins with, whatever its case
    and whatever follows (``users.csv``, ``Users-2024.CSV``,
    ``transaction_items202401_sample.csv``); of several the longest. Other
    files are left out.
    """
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: dict[str, list[str]] = {t: [] for t in LOAD_ORDER}
    files = fs.listFiles(p, True) if fs.exists(p) else None
    while files is not None and files.hasNext():
        path = files.next().getPath()
        stem, dot, kind = path.getName().lower().rpartition(".")
        if kind == "csv" and (fits := [t for t in LOAD_ORDER if stem.startswith(t)]):
            out[max(fits, key=len)].append(path.toString())
    return {t: sorted(paths) for t, paths in out.items()}


def csv_text(spark: SparkSession, root: str, table: str, multi_line: bool = False) -> DataFrame:
    """All files of a table below ``root`` (``table_files``) as text columns, in one plan.

    Empty values and missing trailing columns are null; values beyond the
    declared columns are ignored. No file: an empty frame of the schema. Values
    with quotes follow RFC 4180. Files are split into tasks by size; only with
    ``multi_line``, for files whose values hold line breaks, a file is one task.
    """
    files = table_files(spark, root)[table]
    if not files:
        return spark.createDataFrame([], text_schema(table))
    reader = (
        spark.read.schema(text_schema(table))
        .option("header", True)
        .option("enforceSchema", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("nullValue", "")
        .option("mode", "PERMISSIVE")
    )
    return reader.csv(files)


def csv_typed(spark: SparkSession, root: str, table: str, multi_line: bool = False) -> DataFrame:
    """``csv_text`` with lenient casts: what doesn't parse is null."""
    df = csv_text(spark, root, table, multi_line)
    return df.select(*[F.try_to_timestamp(c).alias(c) if isinstance(typed(c), T.TimestampType) else F.col(c).try_cast(typed(c)).alias(c) for c in COLUMNS[table]])


def scan_directory(spark: SparkSession, root: str) -> Iterator[tuple[str, DataFrame]]:
    """(table, frame) of every source table, dimensions first."""
    for table in LOAD_ORDER:
        yield table, csv_text(spark, root, table)


def pipe_records(df: DataFrame, column: str, names: list[str], sep: str = "|") -> DataFrame:
    """Split delimited records into named text columns, lenient about length.

    Rows with fewer than ``len(names)`` fields and blank or null rows are
    dropped; extra trailing fields are ignored; empty fields become null.
    """
    parts = F.split(F.col(column), "\\" + sep, -1)
    kept = df.where(F.trim(column) != "").withColumn("__parts", parts).where(F.size("__parts") >= len(names))
    return kept.select(*[F.nullif(F.get("__parts", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Bag union by column name; columns that a frame lacks are null there."""
    if not frames:
        raise ValueError("union_all needs at least one frame")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
