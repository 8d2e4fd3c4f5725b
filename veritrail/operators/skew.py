"""Joins that stay balanced when one key holds a large share of the rows.

``HOT_ROWS`` is the row count from which a key counts as hot. At most
``total_rows / HOT_ROWS`` keys can be hot, so the list of hot keys has a size
bound that does not depend on the number of distinct keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veritrail.session import cut_lineage

HOT_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024


def measured_bytes(df: DataFrame) -> int:
    """Approximate size of ``df`` by one aggregate over its columns."""
    parts: list[Column] = []
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.sum(F.octet_length(field.name)), F.lit(0)))
        elif isinstance(field.dataType, T.ArrayType):
            parts.append(F.coalesce(F.sum(F.size(field.name)), F.lit(0)) * 8)
        else:
            parts.append(F.count(F.lit(1)) * 8)
    total = reduce(lambda a, b: a + b, parts).cast("long")
    return int(df.agg(total.alias("n")).first()["n"])


def hot_keys(facts: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys with at least ``hot_rows`` rows, or None when there is none.

    One count over the key columns, combined on the map side.
    """
    counts = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = cut_lineage(counts.where(F.col("_n") >= hot_rows).select(*keys))
    return None if hot.isEmpty() else hot


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
    measured: int | None = None,
) -> DataFrame:
    """Join ``facts`` to ``lookup``, which has one row per key.

    A lookup whose measured size fits is broadcast. A larger one is shuffled,
    with the rows of hot keys taken out and joined to a broadcast of the hot
    lookup rows alone. Pass ``measured`` where the size is known already.
    """
    on = list(keys)
    if (measured_bytes(lookup) if measured is None else measured) <= broadcast_bytes:
        return facts.join(F.broadcast(lookup), on, how)
    hot = hot_keys(facts, on, hot_rows)
    if hot is None:
        return facts.join(lookup, on, how)
    few = F.broadcast(hot)
    hot_lookup = F.broadcast(lookup.join(few, on, "left_semi"))
    cold_part = facts.join(few, on, "left_anti").join(lookup, on, how)
    return cold_part.unionByName(facts.join(few, on, "left_semi").join(hot_lookup, on, how))


def attach_group_stats(
    facts: DataFrame, keys: Sequence[str], stats: dict[str, Column], hot: DataFrame | None
) -> DataFrame:
    """Give every row the aggregates of its group; ``hot`` comes from ``hot_keys``.

    Ordinary groups go through one window. The rows of hot groups stay where
    they are: their aggregates combine on the map side and return by broadcast.
    """
    on = list(keys)
    frame = Window.partitionBy(*on)
    over = {name: agg.over(frame) for name, agg in stats.items()}
    if hot is None:
        return facts.withColumns(over)
    few = F.broadcast(hot)
    hot_part = facts.join(few, on, "left_semi")
    totals = hot_part.groupBy(*on).agg(*[agg.alias(name) for name, agg in stats.items()])
    cold_part = facts.join(few, on, "left_anti").withColumns(over)
    return cold_part.unionByName(hot_part.join(F.broadcast(totals), on).select(*cold_part.columns))
