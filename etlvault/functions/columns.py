"""Small helpers over column names and schemas."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """Column by exact name; dots and spaces in it are taken literally."""
    return F.col("`" + name.replace("`", "``") + "`")


def cols(names: Iterable[str]) -> list[Column]:
    return [col(n) for n in names]


def resolve(df: DataFrame, name: str) -> str | None:
    """The frame's own spelling of ``name``, compared without case; None when absent."""
    wanted = name.lower()
    return next((c for c in df.columns if c.lower() == wanted), None)


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def common_columns(left: DataFrame, right: DataFrame, without: Iterable[str] = ()) -> list[str]:
    """Columns of ``left`` also present in ``right``, in the order of ``left``."""
    skip = {w.lower() for w in without}
    other = {c.lower() for c in right.columns}
    return [c for c in left.columns if c.lower() in other and c.lower() not in skip]


def is_float(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def ratio_pct(part: Column, whole: Column, digits: int) -> Column:
    """``part / whole * 100`` rounded; 0 when ``whole`` is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part * F.lit(100.0) / whole, digits))
