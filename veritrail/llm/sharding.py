"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix (operator 8).

Rows lie in partitions. How many rows each partition sends to each shard is
drawn exactly as a uniform shuffle would have it: a random matrix whose row
sums are the partitions' sizes and whose column sums are the shards' sizes.
Each partition permutes its rows and cuts them by its row of the matrix; each
shard permutes what it receives.

The matrix is drawn in two levels. The driver draws for at most ``GROUPS``
groups of partitions; each group then draws for its own partitions on an
executor. No step sees more than its own part, whatever the number of partitions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.llm.common import python_ready, ranked
from veritrail.session import written_table

GROUPS = 1024
N_SHARDS = 8
EXACT_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among ``n`` drawn without replacement.

    Beyond numpy's limit the law is summed by its exact term ratios over the
    window of 12 standard deviations round the mean (less than 1e-30 lies outside).
    """
    if good + bad < EXACT_LIMIT:
        return int(rng.hypergeometric(good, bad, n)) if good and n else 0
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    mean = n * (good / total)
    width = 12 * (mean * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5 + 12
    x = np.arange(max(low, int(mean - width)), min(high, int(mean + width)) + 1, dtype=np.float64)
    log_ratio = np.log(good - x[:-1]) + np.log(n - x[:-1]) - np.log(x[1:]) - np.log(bad - n + x[1:])
    log_p = np.concatenate([[0.0], np.cumsum(log_ratio)])
    p = np.cumsum(np.exp(log_p - log_p.max()))
    return int(x[np.searchsorted(p, rng.random() * p[-1])])


def matrix(rows: list[int], columns: list[int], rng: np.random.Generator) -> list[list[int]]:
    """Random matrix with the given row and column sums, as a uniform shuffle gives it."""
    left, out = list(columns), []
    for n in rows:
        rest, own = sum(left), []
        for k, size in enumerate(left):
            rest -= size
            own.append(hypergeometric(rng, size, rest, n) if rest else n)
            n -= own[-1]
            left[k] -= own[-1]
        out.append(own)
    return out


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def shuffled_shards(df: DataFrame, n_shards: int = N_SHARDS, seed: int = 5) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long), the row's place in its shard.

    Shard sizes differ by one row at most and slots of a shard are 0 to its size
    less one. The rows, with all their columns, are written once so that
    every later step sees the same partitions; pass the columns that are to
    travel. Columns named ``shard`` or ``slot`` are replaced, ``_part`` and ``_row`` left out. Equal and null
    rows are rows like any other; an empty table gives an empty result.
    """
    spark = df.sparkSession
    python_ready(spark)
    carried = [c for c in df.columns if c.lower() not in ("shard", "slot", "_part", "_row")]
    at = F.monotonically_increasing_id()  # the partition above bit 33, the row below
    rows = written_table(df.select(*carried, at.alias("_row")).withColumn("_part", F.shiftrightunsigned("_row", 33)), "shard-rows")
    groups = max(1, min(GROUPS, (1 << 20) // n_shards))
    sizes = written_table(rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.pmod(F.xxhash64("_part"), F.lit(groups))), "shard-sizes")
    by_group = {r["g"]: r["n"] for r in sizes.groupBy("g").agg(F.sum("n").alias("n")).orderBy("g").collect()}
    drawn = matrix(list(by_group.values()), shard_sizes(sum(by_group.values()), n_shards), np.random.default_rng([seed, n_shards]))
    top = dict(zip(by_group, drawn, strict=True))

    def draw(key, own: pd.DataFrame) -> pd.DataFrame:
        g = int(key[0])
        own = own.sort_values("_part")
        rows_out = matrix(own["n"].tolist(), top[g], np.random.default_rng([seed, n_shards, g + 1]))
        return pd.DataFrame({"_part": own["_part"].to_numpy(), "ends": [np.cumsum(r).tolist() for r in rows_out]})

    ends = written_table(sizes.groupBy("g").applyInPandas(draw, "_part bigint, ends array<bigint>"), "shard-matrix")
    local = Window.partitionBy("_part").orderBy(F.xxhash64("_row", F.lit(seed)), "_row")
    placed = rows.withColumn("_rank", F.row_number().over(local) - 1).join(ends, "_part")
    shard = F.size(F.filter("ends", lambda e: e <= F.col("_rank")))
    placed = placed.select(*carried, "_row", shard.alias("shard"), F.xxhash64("_row", F.lit(seed + 1)).alias("_key"))
    placed = written_table(placed, "shard-placed")
    return ranked(placed, ["shard"], "_key", ["_row"], "slot").select(*carried, "shard", "slot")


def shard_digest(docs: DataFrame, n_shards: int = N_SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row under the law ``rows``.

    A null text has no bytes: size 1, checksum that of nothing. Only digests of
    the texts travel.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(whole) + 1).cast("bigint").alias("size"), F.crc32(whole).alias("text_crc32"))
    return shuffled_shards(narrow, n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS) -> None:
    """Write all columns of ``docs`` below ``path/shard=k``, each shard in the order of its slots."""
    placed = shuffled_shards(docs, n_shards).withColumn("_order", F.col("slot"))
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("_order").write.partitionBy("shard").parquet(path)
