"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.session import ship_package

ARROW_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def python_ready(spark: SparkSession) -> None:
    """Send the package to the Python workers and keep Arrow batches of long texts small."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once however often ``body`` uses it."""
    return F.transform(F.array(value), body).getItem(0)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % folds


def ranked(df: DataFrame, group: Sequence[str], key: str, ties: Sequence[str], out: str, per_bucket: int = 8_192) -> DataFrame:
    """Number the rows of every group 0..n-1 by ``key``, a long with even bits.

    A group of any size is cut into buckets by the leading bits of the key.
    Buckets are numbered apart; running bucket counts are the starting numbers.
    ``df`` is read twice, so it should be a table. Group columns are not null.
    """
    rows = df.count()
    bits = max(0, math.ceil(math.log2(max(1, rows / per_bucket))))
    bucket = F.shiftrightunsigned(F.col(key), 64 - bits) if bits else F.lit(0).cast("long")
    placed = df.withColumn("_rk_bucket", bucket)
    on = [*group, "_rk_bucket"]
    counts = placed.groupBy(*on).agg(F.count(F.lit(1)).alias("_rk_n"))
    before = Window.partitionBy(*group).orderBy("_rk_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*on, F.coalesce(F.sum("_rk_n").over(before), F.lit(0)).alias("_rk_start"))
    inside = Window.partitionBy(*on).orderBy(key, *ties)
    numbered = placed.withColumn("_rk_row", F.row_number().over(inside)).join(starts, on)
    return numbered.withColumn(out, F.col("_rk_start") + F.col("_rk_row") - 1).select(*df.columns, out)
