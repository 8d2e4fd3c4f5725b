"""SimHash near-dedup by deletion-variant signatures (operator 4).

A 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints at
three or fewer differing bits agree in one segment up to at most one bit. Each
distinct fingerprint is indexed under its whole segments and under every
segment with one bit masked out, so such a pair meets in an equality join:
under the whole segment if it is equal, else under the variant whose masked bit
is the differing one. A variant serves only pairs that differ in its bit, so a
variant whose bit is the same in all its members is dropped unread.

Members of a bucket are compared in blocks of bounded size; what leaves a block
is a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrail.llm.common import python_ready
from veritrail.llm.components import block_pairs, components
from veritrail.operators.skew import BROADCAST_BYTES
from veritrail.session import written_table

SHINGLE = 3
SEED = 42
MAX_DISTANCE = 3
SEGMENT_BITS = 32
BLOCK = 1024
CHUNK = 1 << 16
#: row v: the eight bits of byte value v
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def simhash(text: str | None) -> int:
    """Signed 64-bit fingerprint of a whole text; 0 without words."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    last = max(1, len(words) - SHINGLE + 1)
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, last, CHUNK):
        stop = min(last, start + CHUNK)
        own = words[start : stop + SHINGLE - 1]
        n = stop - start
        shingles = map(b" ".join, zip(*(own[k : k + n] for k in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
        hashes = np.array([digest(s, SEED) for s in shingles], dtype=np.uint64)
        columns = hashes.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[8 * k : 8 * k + 8] += np.bincount(columns[:, k], minlength=256) @ BITS
    bits = (2 * counts > last).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def _fp(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t) for t in texts], dtype="int64")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp`` of every row; one Arrow pass, no shuffle. A null text counts as empty."""
    python_ready(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("doc_id"), _fp(F.col(text)).alias("fp"))


def _variants(distinct: DataFrame) -> DataFrame:
    """``key, bit, fp``: two whole segments and 64 segments with one bit masked for each fingerprint."""
    low = F.col("fp").bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
    high = F.shiftrightunsigned("fp", SEGMENT_BITS)
    entries = []
    for side, segment in enumerate((low, high)):
        base = side * (SEGMENT_BITS + 1)
        entries.append(F.struct((segment + F.lit(base << SEGMENT_BITS)).alias("key"), F.lit(-1).alias("bit")))
        for p in range(SEGMENT_BITS):
            masked = segment.bitwiseAND(F.lit(((1 << SEGMENT_BITS) - 1) ^ (1 << p)))
            entries.append(
                F.struct(
                    (masked + F.lit((base + p + 1) << SEGMENT_BITS)).alias("key"),
                    F.shiftright(segment, p).bitwiseAND(F.lit(1)).cast("int").alias("bit"),
                )
            )
    return distinct.select("fp", F.explode(F.array(*entries)).alias("v")).select("v.key", "v.bit", "fp")


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A spanning forest of the links among the fingerprints of each row's block pair."""
    for batch in batches:
        edges: list[tuple[int, int]] = []
        for members in batch["fps"]:
            left = np.asarray(members, dtype=np.int64)
            while len(left) > 1:
                queue, left = [left[0]], left[1:]
                while queue and len(left):
                    at = queue.pop()
                    near = np.bitwise_count((left ^ at).view(np.uint64)) <= MAX_DISTANCE
                    if near.any():
                        found = left[near]
                        left = left[~near]
                        edges.extend((int(at), int(x)) for x in found)
                        queue.extend(found)
        yield pd.DataFrame(edges, columns=["a", "b"], dtype="int64")


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints that connect all pairs within the distance."""
    keyed = _variants(distinct).repartition("key")  # shuffled once, read by the count and by the join
    live = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("bit").alias("low"), F.max("bit").alias("high"))
    live = live.where("n > 1 and (low = -1 or low <> high)").select("key", "n")
    members = block_pairs(keyed.join(live, "key").select("key", "fp", "n"), "key", "fp", "n", block)
    groups = members.groupBy("key", "_i", "_j").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    return groups.mapInPandas(_forests, "a bigint, b bigint")


def classified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``doc_id, fp`` of every row, and ``fp, root, component_id`` of every distinct fingerprint."""
    rows = written_table(fingerprints(docs, doc_id, text), "simhash")
    # copies share a fingerprint: everything below works on distinct ones
    first = written_table(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(links(first.select("fp"), block), "simhash")
    placed = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows, written_table(placed.join(smallest, "root").select("fp", "root", "component_id"), "simhash-classes")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Null and empty texts have fingerprint zero and link like any other. Equal
    ids, equal rows and null ids keep their rows; a component of null ids only
    has a null ``component_id``. An empty table gives an empty result. Columns
    other than the two named are not read.
    """
    rows, classes = classified(docs, doc_id, text, block)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(classes, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def _shipped(ids: DataFrame) -> DataFrame:
    """Ids whose counted size fits a broadcast spare the texts a shuffle; 16 bytes to a row."""
    return F.broadcast(ids) if 16 * ids.count() <= BROADCAST_BYTES else ids


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest id.

    Rows of a repeated id, and rows without one, are told apart by their
    fingerprints; where several could stay in a component, any one of them does.
    A row without an id stays only where its component has no id.
    """
    rows, classes = classified(docs, doc_id, text)
    wins = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = rows.join(classes, "fp").where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(wins).alias("wins"))
    ids = written_table(ids.where("wins"), "simhash-kept")
    named = ids.select(F.col("doc_id").alias(doc_id), "n")
    single = docs.join(_shipped(named.where("n = 1").select(doc_id)), doc_id, "left_semi").select(*docs.columns)
    repeated = docs.join(_shipped(named.where("n > 1").select(doc_id)), doc_id, "left_semi").select(*docs.columns)
    unclear = repeated.unionByName(docs.where(F.col(doc_id).isNull()))
    names = {"fp": "_sh_fp", "root": "_sh_root", "component_id": "_sh_first"}
    unclear = unclear.withColumn("_sh_fp", _fp(F.col(text))).join(classes.withColumnsRenamed(names), "_sh_fp")
    unclear = unclear.where(F.col(doc_id).eqNullSafe(F.col("_sh_first"))).dropDuplicates(["_sh_root"])
    return single.unionByName(unclear.select(*docs.columns))
