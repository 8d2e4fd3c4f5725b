"""Token columns: splitting, ids, truncation, padding, masks, trimming, decoding."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.operators.skew import BROADCAST_BYTES, lookup_join, measured_bytes
from veritrail.session import cut_lineage, ship_package

MAX_LEN = 4096

Tokeniser = Callable[[Column], Column]


def split_tokens(text: str | Column) -> Column:
    """Whitespace tokens, none of them empty."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def token_id(token: Column, vocab: int) -> Column:
    """Stable id from the first eight md5 hex digits, modulo the vocabulary."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long"), F.lit(vocab)).cast("int")


def token_ids(tokens: Column, vocab: int) -> Column:
    return F.transform(tokens, lambda t: token_id(t, vocab))


def hash_tokeniser(vocab: int) -> Tokeniser:
    """Default tokeniser; any column function or ``pandas_udf`` may replace it."""
    return lambda text: token_ids(split_tokens(text), vocab)


def left_truncate(seq: Column, max_len: int | None = None) -> Column:
    """Drop the start of a sequence longer than ``max_len``; None cuts nothing."""
    if max_len is None:
        return seq
    return F.slice(seq, F.greatest(F.size(seq) - F.lit(max_len - 1), F.lit(1)), F.lit(max_len))


def pad_batch(df: DataFrame, seq: str, batch: str, pad: int | Column, side: str = "left") -> DataFrame:
    """Pad to the longest sequence of the batch; adds ``padded`` and ``padded_to``.

    ``pad`` is one element: an id, or a zero vector for sequences of vectors.
    The window frame is one batch, whose row count the batch size fixes.
    """
    longest = F.max(F.size(seq)).over(Window.partitionBy(batch))
    wide = df.withColumn("padded_to", longest)
    fill = F.array_repeat(F.lit(pad), F.col("padded_to") - F.size(seq))
    parts = (fill, F.col(seq)) if side == "left" else (F.col(seq), fill)
    return wide.withColumn("padded", F.concat(*parts))


def attention_mask(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda x: (x != F.lit(pad)).cast("int"))


def mask_length(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda m: m == 1))


def trim_padding(seq: Column, length: Column, side: str = "left") -> Column:
    """Last ``length`` items of a left-padded sequence, else the first ones."""
    if side == "left":
        kept = F.slice(seq, F.size(seq) - length + 1, length)
    else:
        kept = F.slice(seq, F.lit(1), length)
    return F.when(length > 0, kept).otherwise(F.slice(seq, 1, 0))


def trim_by_mask(seq: Column, mask: Column) -> Column:
    """Items whose mask is set, wherever the padding stands."""
    return F.filter(seq, lambda x, i: F.get(mask, i) == 1)


def new_tokens(ids: Column, prompt_length: Column) -> Column:
    """Tokens generated after the prompt."""
    return F.slice(ids, prompt_length + 1, F.greatest(F.size(ids) - prompt_length, F.lit(0)))


def has_eos(ids: Column, eos: int) -> Column:
    return F.coalesce(F.array_contains(ids, F.lit(eos)), F.lit(False))


def decode(
    df: DataFrame, key: str, ids: str, vocabulary: DataFrame, specials: tuple[int, ...] = (), sep: str = " ",
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(key, text)`` with special ids skipped; ``vocabulary`` is ``(token_id, token)``.

    Null ids count as special. An id outside the vocabulary fails the job. A
    vocabulary of at most ``max_bytes``, by measure, is shipped and sequences are
    decoded where they stand; beyond that, tokens meet it by a join.
    """
    given = F.coalesce(F.col(ids).cast("array<bigint>"), F.array().cast("array<bigint>"))
    plain = df.select(key, F.filter(given, lambda x: x.isNotNull() & (~x.isin(*specials) if specials else F.lit(True))).alias("ids"))
    if measured_bytes(vocabulary) <= max_bytes:
        return plain.select(key, _decoder(vocabulary, sep)(F.col("ids")).alias("text"))
    return _decode_join(plain, key, vocabulary, sep)


def _decoder(vocabulary: DataFrame, sep: str):
    spark = vocabulary.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast({int(r["token_id"]): r["token"] for r in vocabulary.collect()})

    @F.pandas_udf("string")
    def decoded(batch: pd.Series) -> pd.Series:
        try:
            return pd.Series([sep.join([shared.value[i] for i in row.tolist()]) for row in batch], dtype=object)
        except KeyError as missing:
            raise ValueError(f"token id {missing.args[0]} is not in the vocabulary") from missing

    return decoded


def _decode_join(plain: DataFrame, key: str, vocabulary: DataFrame, sep: str) -> DataFrame:
    """Sequences are told apart by a number of their own, so equal keys stay apart; none grows beyond its row."""
    rows = cut_lineage(plain.withColumn("_seq", F.monotonically_increasing_id()))
    long = rows.select("_seq", F.posexplode("ids").alias("pos", "token_id"))
    named = lookup_join(long, vocabulary.withColumn("token_id", F.col("token_id").cast("bigint")), ["token_id"], "left")
    unknown = F.raise_error(F.format_string("token id %d is not in the vocabulary", "token_id")).cast("string")
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("token", unknown).alias("token"))))
    texts = named.groupBy("_seq").agg(F.array_join(ordered["token"], sep).alias("text"))
    return rows.select("_seq", key).join(texts, "_seq", "left").select(key, F.coalesce("text", F.lit("")).alias("text"))
