"""Column functions for raw fields: string coercion, labels, blank tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_text(col: str | Column) -> Column:
    """Text of any scalar; a null becomes ``None`` as text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit("None"))


def truthy(variant: str | Column) -> Column:
    """1 for a JSON value that is truthy in Python, else 0.

    Any non-empty string is 1, ``"false"`` included; null, zero, false and
    empty strings, arrays and objects are 0.
    """
    v = F.col(variant) if isinstance(variant, str) else variant
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    return (
        F.when(v.isNull() | (kind == "VOID"), F.lit(0))
        .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int"))
        .when(kind == "STRING", (F.length(text) > 0).cast("int"))
        .when(kind.startswith("ARRAY"), (text != "[]").cast("int"))
        .when(kind.startswith("OBJECT"), (text != "{}").cast("int"))
        .otherwise((F.try_variant_get(v, "$", "double") != 0).cast("int"))
    )


def strict_label(variant: str | Column) -> Column:
    """Label from real booleans and their spellings; anything else is null."""
    v = F.col(variant) if isinstance(variant, str) else variant
    text = F.lower(F.try_variant_get(v, "$", "string"))
    return F.when(text.isin("true", "1"), F.lit(1)).when(text.isin("false", "0"), F.lit(0))


def is_blank(col: str | Column) -> Column:
    """Whether nothing but Unicode white space is there, by the rule of Python's ``strip``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", "") == ""
