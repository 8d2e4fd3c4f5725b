"""Progressive prefixes: every ``stride_k`` tokens, plus the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRIDE_K = 100
#: the cap of a capped extraction; nothing is cut unless it is passed
MAX_LENGTH = 1024


def effective_length(length: Column, max_length: int | None) -> Column:
    return F.least(length, F.lit(max_length)) if max_length else length


def prefix_lengths(
    length: Column,
    stride_k: int = STRIDE_K,
    max_length: int | None = None,
    include_final: bool = True,
) -> Column:
    """Array of prefix lengths of one sequence, empty for an empty sequence."""
    end = effective_length(length, max_length)
    rounding = F.ceil if include_final else F.floor
    steps = rounding(end / F.lit(stride_k)).cast("int")
    return F.when(
        steps > 0,
        F.transform(F.sequence(F.lit(1), steps), lambda i: F.least(i * stride_k, end).cast("int")),
    ).otherwise(F.array().cast("array<int>"))


def prefix_index(
    df: DataFrame,
    length: str = "length",
    stride_k: int = STRIDE_K,
    max_length: int | None = None,
    include_final: bool = True,
) -> DataFrame:
    """One row per prefix; every column of ``df`` is carried along."""
    ends = prefix_lengths(F.col(length), stride_k, max_length, include_final)
    return df.select("*", F.explode(ends).alias("prefix_length"))


def prefix_id(original_id: str | Column) -> Column:
    c = F.col(original_id) if isinstance(original_id, str) else original_id
    return F.concat(c.cast("string"), F.lit("_prefix"), F.col("prefix_length").cast("string"))


def prefix_slice(seq: Column) -> Column:
    """The first ``prefix_length`` items of a sequence column."""
    return F.slice(seq, F.lit(1), F.col("prefix_length"))


def last_states(states: DataFrame, prefixes: DataFrame, id_col: str = "id") -> DataFrame:
    """State at each prefix end: equi-join on ``(id, pos = prefix_length - 1)``.

    ``states`` is the long table ``(id, pos, vec)``; no prefix is ever cut out
    of it, and the key pair spreads even one very long sequence.
    """
    wanted = prefixes.withColumn("pos", F.col("prefix_length") - 1)
    return wanted.join(states, [id_col, "pos"]).drop("pos")
