"""Embedding near-dedup: random-hyperplane hashing, exact cosine, components (operator 3).

Each of several tables hashes a vector to the signs of its products with random
planes. Bits per table grow with the logarithm of the largest label, so buckets
of unrelated vectors stay small; the number of tables follows from the wanted
recall for a pair exactly at the threshold. Candidates are verified by exact
cosine in double precision inside bounded blocks of a bucket. A pair is counted
in the first table in which its codes agree and nowhere else; a block emits
link counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import python_ready
from veritrail.llm.components import block_pairs, components
from veritrail.session import written_table

THRESHOLD = 0.98
MISS = 1e-5
BLOCK = 512
MIN_BITS, MAX_BITS = 8, 30


def tables_for(rows: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Bits to a table and number of tables, so that a pair at the threshold is missed with chance ``miss`` at most."""
    bits = min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(max(2, rows)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-agree))


def codes_of(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], bits * tables))
    signs = (vectors @ planes >= 0).reshape(len(vectors), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _verified(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Counts ``(a, null, n)`` and forest edges ``(a, b, null)`` of every block pair."""
        for batch in batches:
            out: list[tuple] = []
            for table, first, second, members in zip(batch["table"], batch["_i"], batch["_j"], batch["members"], strict=True):
                ids = np.array([m["vid"] for m in members], dtype=np.int64)
                own = np.array([m["own"] for m in members])
                weight = np.array([m["weight"] for m in members], dtype=np.int64)
                codes = np.array([m["codes"] for m in members], dtype=np.int64)
                x = np.array([m["v"] for m in members], dtype=np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                near = x @ x.T >= threshold
                np.fill_diagonal(near, False)
                if first != second:  # pairs inside one block belong to that block's own pair
                    near &= own[:, None] != own[None, :]
                for t in range(table):
                    near &= codes[:, t][:, None] != codes[:, t][None, :]
                counts = near @ weight
                out.extend((int(i), None, int(n)) for i, n in zip(ids, counts, strict=True) if n)
                left = np.flatnonzero(near.any(axis=1))
                seen = np.zeros(len(ids), dtype=bool)
                for start in left:
                    if seen[start]:
                        continue
                    seen[start], queue = True, [start]
                    while queue:
                        at = queue.pop()
                        new = np.flatnonzero(near[at] & ~seen)
                        seen[new] = True
                        queue.extend(new)
                        out.extend((int(ids[at]), int(ids[k]), None) for k in new)
            frame = pd.DataFrame(out, columns=["a", "b", "n"])
            yield frame.astype({"a": "int64", "b": "Int64", "n": "Int64"})

    return run


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK, seed: int = 11,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Vectors link when labels are equal and not null, lengths are equal and the
    cosine reaches ``threshold``. Null, empty or zero vectors, and those with
    null or non-finite parts, link with nothing, their own copies included.
    Equal vectors are compared once and counted by their number. A row with a
    null id links like any other and is no component's id unless it stands
    alone; repeated ids keep their rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    python_ready(spark)
    v = F.transform(embedding, lambda x: x.cast("double"))
    fine = (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), v.alias("v"))
    rows = rows.withColumn("linkable", F.coalesce(fine & F.col("label").isNotNull(), F.lit(False)))
    key = F.when(F.col("linkable"), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.transform("v", lambda x: (x + 0.0).cast("string"))), 256))
    rows = written_table(rows.withColumn("key", key), "near-rows")

    same = rows.where("linkable").groupBy("key", "label").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("weight"), F.min("v").alias("v"))
    same = written_table(same.withColumn("vid", F.monotonically_increasing_id()), "near-distinct")
    largest = same.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    bits, tables = tables_for(largest, threshold, miss)

    @F.pandas_udf("array<bigint>")
    def coded(batch: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(batch), dtype=object)
        sizes = batch.map(len)
        for size in sizes.unique():
            at = np.flatnonzero(sizes == size)
            found = codes_of(np.stack(batch.iloc[at].to_numpy()).astype(np.float64), bits, tables, seed)
            for k, c in zip(at, found, strict=True):
                out.iloc[k] = c
        return out

    hashed = written_table(same.withColumn("codes", coded("v")), "near-codes")
    where = F.xxhash64("label", F.size("v"), "table", "code").alias("bucket")
    entries = hashed.select("vid", "label", "v", F.posexplode("codes").alias("table", "code")).select("vid", "table", where)
    crowded = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    placed = block_pairs(entries.join(crowded, "bucket"), "bucket", "vid", "n", block)
    full = placed.join(hashed.select("vid", "weight", "codes", "v"), "vid")
    member = F.struct("vid", F.col("_own").alias("own"), "weight", "codes", "v")
    groups = full.groupBy("bucket", "table", "_i", "_j").agg(F.collect_list(member).alias("members")).where(F.size("members") > 1)
    found = written_table(groups.select("table", "_i", "_j", "members").mapInPandas(_verified(threshold), "a bigint, b bigint, n bigint"), "near-links")

    counts = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("others"))
    roots = components(found.where("b is not null").select("a", "b"), "near")
    classes = same.select("vid", "key", "first", "weight").join(counts.withColumnRenamed("a", "vid"), "vid", "left")
    classes = classes.join(roots.withColumnRenamed("node", "vid"), "vid", "left").withColumn("root", F.coalesce("root", "vid"))
    smallest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = classes.join(smallest, "root").select("key", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    classes = written_table(classes, "near-classes")

    linked = rows.where("linkable").join(classes, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where("not linkable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
