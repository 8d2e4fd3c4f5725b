"""Seeded order, gap-free ordinals, shard placement, batches and exact splits.

No operator here sorts the whole table in one task. Rows are placed in
``16 ** digits`` buckets by the leading hex digits of a seeded md5 key. The
buckets are even by construction, their counts are summed to starting offsets
(a table whose size the digits fix), and each bucket is numbered on its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.operators.skew import lookup_join
from veritrail.session import cut_lineage

BUCKET_DIGITS = 4


def seeded_key(seed: int | str, *id_cols: str) -> Column:
    """md5 of ``seed:id[:id...]``, the sort key of the seeded order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in id_cols]))


def _offsets(counts: DataFrame, slot: str) -> DataFrame:
    # ``counts`` has one row per bucket: its size is fixed by the bucket count
    whole = Window.orderBy(slot)
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    full = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.select(
        slot,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(full).alias("_total"),
    )


def with_seeded_ordinal(
    df: DataFrame,
    id_cols: str | Sequence[str],
    seed: int | str = 42,
    out: str = "ordinal",
    then: Sequence[str] = (),
    total: str | None = None,
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Number rows 0..n-1 in seeded order; equal keys go by id, then ``then``.

    The order depends on the seed and the ids only, not on partitioning. Ids
    must be unique up to ``then``: equal ids share a bucket. With ``total`` the
    row count is attached under that name.
    """
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    key = seeded_key(seed, *ids)
    keyed = df.withColumn("_key", key).withColumn("_slot", F.substring("_key", 1, digits))
    counts = (
        df.select(F.substring(key, 1, digits).alias("_slot"))
        .groupBy("_slot")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    inside = Window.partitionBy("_slot").orderBy("_key", *ids, *then)
    numbered = keyed.withColumn("_row", F.row_number().over(inside)).join(
        F.broadcast(_offsets(counts, "_slot")), "_slot"
    )
    cols = [F.col(c) for c in df.columns]
    cols.append((F.col("_before") + F.col("_row") - 1).cast("long").alias(out))
    if total:
        cols.append(F.col("_total").cast("long").alias(total))
    return numbered.select(*cols)


def with_range_ordinal(
    df: DataFrame, order_cols: Sequence[str], out: str = "ordinal", partitions: int | None = None
) -> DataFrame:
    """Number rows 0..n-1 by ``order_cols``, which must end in a unique column.

    Range bounds are sampled, so the sorted rows are cut from their lineage
    before they are read for the counts and for the result.
    """
    cols = [F.col(c) for c in order_cols]
    ranged = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    placed = cut_lineage(
        ranged.sortWithinPartitions(*cols).withColumn("_pos", F.monotonically_increasing_id())
    )
    # monotonically_increasing_id keeps the partition above bit 33, the row below
    placed = placed.withColumn("_slot", F.shiftrightunsigned("_pos", 33)).withColumn(
        "_row", F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1))
    )
    counts = placed.groupBy("_slot").agg(F.count(F.lit(1)).alias("_n"))
    return placed.join(F.broadcast(_offsets(counts, "_slot")), "_slot").select(
        *df.columns, (F.col("_before") + F.col("_row")).cast("long").alias(out)
    )


def with_running_start(
    df: DataFrame, ordinal: str, size: str, out: str, slots: int = 1 << 16, least: int = 1 << 13
) -> DataFrame:
    """Add the sum of ``size`` over all rows before, by the whole number ``ordinal``, which must be unique.

    Places of what every row will give are known before it is made. Rows go to
    at most ``slots`` ranges of at least ``least`` ordinals; each range is summed
    on its own over ordinal and size only, and meets ``df`` by the ordinal.
    """
    narrow = df.select(ordinal, F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_items"))
    top = narrow.agg(F.max(ordinal)).first()[0]
    width = max(least, -(-((top or 0) + 1) // slots))
    narrow = narrow.withColumn("_slot", F.expr(f"{ordinal} div {width}"))
    sums = narrow.groupBy("_slot").agg(F.sum("_items").alias("_n"))
    before = Window.partitionBy("_slot").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    inside = narrow.withColumn("_own", F.coalesce(F.sum("_items").over(before), F.lit(0)))
    starts = inside.join(F.broadcast(_offsets(sums, "_slot")), "_slot").select(ordinal, (F.col("_before") + F.col("_own")).cast("long").alias(out))
    return df.join(starts, ordinal).select(*df.columns, out)


def scan_order(catalog: DataFrame, out: str = "scan_pos", file: str = "shard_file", local: str = "local_idx") -> DataFrame:
    """Number rows as a scan over files sorted by name meets them.

    Names are compared as text: ``shard_10000.pt`` comes before ``shard_9999.pt``.
    """
    return with_range_ordinal(catalog, [file, local], out)


def first_batches(
    df: DataFrame, id_col: str, seed: int | str = 42, batch_size: int = 12, last_batch: int = 11, out: str = "ordinal"
) -> DataFrame:
    """The rows that ``early_stop`` keeps of the seeded order, with their ordinals, without numbering the others.

    A top-k: every task hands on ``batch_size * (last_batch + 1)`` rows at most.
    """
    keyed = df.withColumn("_key", seeded_key(seed, id_col))
    top = keyed.orderBy("_key", id_col).limit(batch_size * (last_batch + 1))
    row = F.row_number().over(Window.orderBy("_key", id_col))
    return top.select(*df.columns, (row - 1).cast("long").alias(out))


def sample_id(ordinal: str, prefix: str = "ex_", width: int = 6) -> Column:
    """``ex_000017`` for records, ``sample_0000017`` for prefix vectors."""
    return F.format_string(f"{prefix}%0{width}d", F.col(ordinal))


def shard_placement(ordinal: str, size: int) -> list[Column]:
    """Shard number, place in the shard and file name for a gap-free ordinal."""
    # fixed value: the file name format that catalogs carry
    shard = F.floor(F.col(ordinal) / F.lit(size)).cast("int")
    return [
        shard.alias("shard_idx"),
        F.pmod(F.col(ordinal), F.lit(size)).cast("int").alias("local_idx"),
        F.format_string("shard_%04d.pt", shard).alias("shard_file"),
    ]


def batch_id(ordinal: str, size: int) -> Column:
    return F.floor(F.col(ordinal) / F.lit(size)).cast("long")


def early_stop(df: DataFrame, ordinal: str, batch_size: int = 12, last_batch: int = 11) -> DataFrame:
    """Keep the batches up to and including ``last_batch``."""
    return df.where(F.col(ordinal) < F.lit(batch_size * (last_batch + 1)))


def with_split(
    df: DataFrame,
    id_cols: str | Sequence[str],
    val_split: float = 0.1,
    seed: int = 42,
    out: str = "split",
    group_col: str | None = None,
) -> DataFrame:
    """Exact-size random split: ``int(n * val_split)`` rows are ``val``.

    With ``group_col`` the split counts and places whole groups instead, so
    rows of one original never fall on both sides.
    """
    if val_split <= 0:
        return df.withColumn(out, F.lit("train"))
    side = F.when(
        F.col("_ordinal") < F.floor(F.col("_n_rows") * F.lit(float(val_split))), F.lit("val")
    ).otherwise(F.lit("train"))
    if group_col is None:
        placed = with_seeded_ordinal(df, id_cols, seed, "_ordinal", total="_n_rows")
        return placed.withColumn(out, side).drop("_ordinal", "_n_rows")
    groups = df.select(group_col).distinct()
    placed = with_seeded_ordinal(groups, group_col, seed, "_ordinal", total="_n_rows")
    return lookup_join(df, placed.select(group_col, side.alias(out)), [group_col])


def with_epoch_batches(
    df: DataFrame, id_cols: str | Sequence[str], batch_size: int, seed: int, epoch: int | None
) -> DataFrame:
    """Batches for one epoch: reshuffled by epoch, or fixed when it is None."""
    order = f"{seed}:{epoch}" if epoch is not None else f"{seed}:eval"
    placed = with_seeded_ordinal(df, id_cols, order, "_ordinal")
    return placed.withColumn("batch_id", batch_id("_ordinal", batch_size)).drop("_ordinal")
