"""Connected components of a distributed edge table, and bounded blocks of large buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.session import written_table


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``, longs; equal roots mean connected.

    Each round maps a node to the first of its closed neighbourhood and renames
    the edges by that map, which keeps connected what was connected. The first
    round takes the smallest node, which finishes stars; later rounds take the
    smallest hash, which shrinks paths and stars by a constant share whatever
    their ids. Both are map-side combined minima. Every round is a written
    table, so that a lost executor costs one task. An empty table gives none.
    """
    left = written_table(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-edges"
    )
    maps: list[DataFrame] = []
    while not left.isEmpty():
        turn = len(maps)

        def order(c, turn=turn):
            return F.col(c) if turn == 0 else F.xxhash64(F.col(c), F.lit(turn))

        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(F.struct(order("b").alias("o"), F.col("b").alias("n"))).alias("m"))
        own = F.struct(order("a").alias("o"), F.col("a").alias("n"))
        step = written_table(first.select(F.col("a").alias("node"), F.least("m", own)["n"].alias("root")), f"{name}-map")
        maps.append(step)
        renamed = left.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(
            step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b"
        )
        left = written_table(
            renamed.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            f"{name}-edges",
        )
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    label = maps[0]
    for step in maps[1:]:
        later = step.select(F.col("node").alias("root"), F.col("root").alias("later"))
        label = label.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
    return written_table(label, f"{name}-roots")


def block_pairs(rows: DataFrame, bucket: str, member: str, size: str, block: int) -> DataFrame:
    """Give each row of a bucket the pairs of blocks it belongs to, as ``_i, _j``.

    A bucket of ``size`` rows is cut into blocks of about ``block`` rows by the
    hash of ``member``. Any two rows of a bucket share exactly one pair or, in
    one block, several; no pair of blocks holds more than about ``2 * block``.
    """
    n = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(member, F.lit("block")), n).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 1),
        lambda j: F.struct(F.least(F.col("_own"), j).alias("_i"), F.greatest(F.col("_own"), j).alias("_j")),
    )
    placed = rows.withColumn("_n", n).withColumn("_own", own)
    return placed.withColumn("_p", F.explode(pairs)).select(*rows.columns, "_own", "_p._i", "_p._j")
