"""Result sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import fixed_places
from ..session import _fs, scratch_path


#: Quotes by RFC 4180, and values with their outer spaces.
_AS_IT_IS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def as_text(df: DataFrame, decimals: dict[str, int] | None = None) -> DataFrame:
    """Columns as result text: fractions with a fixed number of places, never in exponent form; null stays null."""
    places = decimals or {}
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if f.name in places or isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = fixed_places(c, places.get(f.name, 2))
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, single_file: bool = False, decimals: dict[str, int] | None = None) -> None:
    """Headered CSV with proper quoting, committed atomically by Spark's committer.

    ``single_file`` is for final reports of a known small size only; else
    every partition writes its own part.
    """
    text = as_text(df, decimals)
    (text.coalesce(1) if single_file else text).write.mode("overwrite").option("header", True).options(**_AS_IT_IS).csv(path)


def deliver(results: dict[str, DataFrame], root: str, write: Callable[[DataFrame, str], None] | None = None) -> dict[str, str]:
    """Write each named result below ``root``; returns the paths."""
    put = write or (lambda df, path: write_csv(df, path))
    paths = {}
    for name, df in results.items():
        put(df, paths.setdefault(name, f"{root}/{name}_results"))
    return paths


def write_table_files(df: DataFrame, root: str, table: str, name: str | None = None) -> None:
    """Headered CSV files ``root/table_00000.csv`` and on (``name`` in place of the table's), as ``readers.csv_text`` finds them.

    Parts are written aside and renamed one by one when all are complete.
    Times are written as ``YYYY-MM-DD HH:MM:SS``; null is an empty value.
    """
    spark = df.sparkSession
    text = [F.date_format(f.name, "yyyy-MM-dd HH:mm:ss").alias(f.name) if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else F.col(f"`{f.name}`").cast("string").alias(f.name) for f in df.schema]
    aside = scratch_path(spark, table)
    df.select(*text).write.option("header", True).options(**_AS_IT_IS).option("emptyValue", "").option("nullValue", "").csv(aside)
    fs, p = _fs(spark, aside)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(path(f"{root}/{name or table}").getParent())
    for i, s in enumerate(sorted((s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")), key=lambda x: x.getName())):
        fs.rename(s, path(f"{root}/{name or table}_{i:05d}.csv"))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row and line, as test receivers dump them; nulls are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
