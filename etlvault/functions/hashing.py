"""Hash keys, hash differences and row digests as built-in expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from etlvault.functions.columns import col

KEY_SEPARATOR = "||"
ROW_SEPARATOR = "|"


def as_text(name: str, scales: Mapping[str, int] | None = None) -> Column:
    """String form of a column.

    ``scales`` fixes the decimal places of floating columns, whose plain string form
    switches to scientific notation for large values.
    """
    column = col(name)
    if scales and name in scales:
        column = column.cast(T.DecimalType(38, scales[name]))
    return column.cast("string")


def _digest(text: Column, algorithm: str) -> Column:
    if algorithm == "md5":
        return F.md5(text)
    if algorithm == "sha256":
        return F.sha2(text, 256)
    raise ValueError(f"unknown hash algorithm: {algorithm}")


def hash_key(columns: Sequence[str], algorithm: str = "md5",
             scales: Mapping[str, int] | None = None) -> Column:
    """Hash of the joined business key; a NULL in any part gives a NULL hash."""
    parts: list[Column] = []
    for i, name in enumerate(columns):
        if i:
            parts.append(F.lit(KEY_SEPARATOR))
        parts.append(as_text(name, scales))
    return _digest(F.concat(*parts), algorithm)


def hash_diff(columns: Sequence[str], algorithm: str = "md5",
              scales: Mapping[str, int] | None = None) -> Column:
    """Hash of the payload in the given order, NULL read as the empty string."""
    parts = [F.coalesce(as_text(c, scales), F.lit("")) for c in columns]
    return _digest(F.concat_ws(KEY_SEPARATOR, *parts), algorithm)


def normalised_key(columns: Sequence[str]) -> Column:
    """Second key form: trimmed upper-case parts, SHA-256, upper-case, first 32 characters."""
    parts = [F.upper(F.trim(as_text(c))) for c in columns]
    text = F.concat_ws(ROW_SEPARATOR, *[F.coalesce(p, F.lit("")) for p in parts])
    return F.left(F.upper(F.sha2(text, 256)), F.lit(32))


def row_digest(columns: Sequence[str], scales: Mapping[str, int] | None = None) -> Column:
    """MD5 of the row's joined string values; a missing value reads ``None``."""
    parts = [F.coalesce(as_text(c, scales), F.lit("None")) for c in columns]
    return F.md5(F.concat_ws(ROW_SEPARATOR, *parts))
