"""Projection, required-value and id cleaning by table spec."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import canonical_id, empty_to_null
from ..schemas import TableSpec


def clean(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Keep ``spec.want`` in that order; drop rows where a required value is missing.

    Null and the empty string are missing; text of spaces is a value. Ids named
    in ``spec.whole_number_ids`` are written as whole numbers where they denote
    one and stay as they are elsewhere. Other columns of ``df`` are dropped, so
    clashing extra names do no harm. An empty table gives an empty table.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    cols = []
    for c in spec.want:
        v = F.col(f"`{c}`")
        if isinstance(kinds[c], T.StringType):
            v = empty_to_null(v)
            if c in spec.whole_number_ids:
                v = canonical_id(v)
        cols.append(v.alias(c))
    return df.select(*cols).na.drop(subset=spec.required)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """Second pass: drop rows in which any of ``columns`` is null or empty."""
    keep = F.lit(True)
    for f in df.schema:
        if f.name in columns:
            c = F.col(f"`{f.name}`")
            keep = keep & (c.isNotNull() & (c != "") if isinstance(f.dataType, T.StringType) else c.isNotNull())
    return df.where(keep)
