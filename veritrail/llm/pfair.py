"""Mixing of sources to target weights by Pfair scheduling (operator 1).

Every source deals out blocks of ``block_rows`` rows. Block ``j`` of a source of
weight ``w`` is released at slot ``floor(j / w)`` and due by ``ceil((j + 1) / w)``;
in each slot the released block with the earliest deadline goes. Weights are
whole multiples of ``1 / period``, so the schedule repeats after ``period``
slots and has dealt each source exactly its share by then: one period is
scheduled on the driver, whatever the size of the corpus, and block ``j`` of a
source with quota ``q`` takes slot ``(j div q) * period + pattern[j mod q]``.
At every slot each source is less than one block from its target.

A source that has run out leaves its slots empty; the others go on in the same
proportions. Every row is placed once: nothing is dropped or repeated.
"""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import ranked

PERIOD = 4096
BLOCK_ROWS = 64
MAX_SOURCES = 1 << 16
OUT = ("mix_weight", "mix_block", "mix_row", "mix_release", "mix_deadline", "mix_slot")


def quotas(weights: dict, period: int = PERIOD) -> tuple[dict, int]:
    """Weights as whole shares of a period (largest remainder, at least one each), and the period.

    The period is the given one, or 16 slots to a source where that is more.
    """
    if not weights:
        return {}, period
    if any(not w > 0 or w == float("inf") for w in weights.values()):
        raise ValueError("target weights must be positive and finite")
    if len(weights) > MAX_SOURCES:
        raise ValueError(f"{len(weights)} sources, more than the {MAX_SOURCES} a weights table may name")
    period = max(period, 16 * len(weights))
    total = sum(weights.values())
    names = sorted(weights, key=lambda s: (s is not None, s))
    exact = {s: weights[s] / total * period for s in names}
    share = {s: max(1, int(exact[s])) for s in names}
    by_remainder = sorted(names, key=lambda s: share[s] - exact[s])
    k = 0
    while sum(share.values()) != period:
        missing = period - sum(share.values())
        if missing > 0:
            for s in by_remainder[:missing]:
                share[s] += 1
        else:
            for s in sorted((s for s in names if share[s] > 1), key=lambda s: exact[s] - share[s])[:-missing]:
                share[s] -= 1
        k += 1
    return share, period


def pattern(share: list[int], period: int) -> list[list[int]]:
    """Slots of each source's blocks in one period: earliest deadline first among the released ones."""
    released: list[list[tuple[int, int]]] = [[] for _ in range(period)]
    for source, q in enumerate(share):
        for j in range(q):
            released[j * period // q].append((-(-(j + 1) * period // q), source))
    slots: list[list[int]] = [[] for _ in share]
    ready: list[tuple[int, int]] = []
    for slot, new in enumerate(released):
        for item in new:
            heappush(ready, item)
        deadline, source = heappop(ready)
        assert slot < deadline
        slots[source].append(slot)
    return slots


def source_key(source: str) -> Column:
    """A group key that is never null: null is a source of its own."""
    return F.when(F.col(source).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(source).cast("string")))


def tempered_weights(docs: DataFrame, source: str = "source", power: float = 0.5) -> dict:
    """Target weights in proportion to a power of each source's row count, by its key.

    1 keeps the corpus's own mix, 0 gives every source the same weight. The
    counts come from all rows; more than ``MAX_SOURCES`` sources are refused.
    """
    counts = docs.groupBy(source_key(source).alias("k")).count().limit(MAX_SOURCES + 1).collect()
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return {r["k"]: float(r["count"]) ** power for r in counts}


def mix(
    docs: DataFrame, weights: dict, source: str = "source", doc_id: str = "doc_id",
    block_rows: int = BLOCK_ROWS, period: int = PERIOD, seed: int = 0,
) -> DataFrame:
    """``docs`` with the columns of ``OUT``; order by ``mix_slot, mix_row`` is the mix.

    ``weights`` goes by source key (``+name``, or ``-`` for rows without a
    source) and must name every source of ``docs``, else the query fails. Within
    a source the order is that of the seeded hash of the id; rows of one id, and
    repeated rows, follow each other in any order. Columns that bear the names
    of ``OUT`` are replaced. ``docs`` is read three times, so it should be a
    table. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    share, period = quotas(weights, period)
    names = list(share)
    slots = pattern(list(share.values()), period) if names else []
    plan = spark.createDataFrame(
        [(s, share[s] / period, share[s], slots[k]) for k, s in enumerate(names)],
        "_pf_src string, mix_weight double, _pf_q bigint, _pf_slots array<bigint>",
    )
    kept = [c for c in docs.columns if c.lower() not in OUT]
    keyed = docs.select(*kept).withColumn("_pf_src", source_key(source)).withColumn("_pf_key", F.xxhash64(F.col(doc_id), F.lit(seed)))
    placed = ranked(keyed, ["_pf_src"], "_pf_key", [doc_id], "_pf_rank")
    # the plan holds ``period`` numbers in all, at most 16 * MAX_SOURCES
    joined = placed.join(F.broadcast(plan), "_pf_src", "left")
    unknown = F.raise_error(F.concat(F.lit("no target weight for source "), F.col("_pf_src"))).cast("bigint")
    q = F.coalesce("_pf_q", unknown)
    block = F.expr(f"_pf_rank div {block_rows}")
    joined = joined.withColumn("_pf_q", q).withColumn("mix_block", block).withColumn("mix_row", F.expr(f"_pf_rank % {block_rows}"))
    return joined.select(
        *kept, "mix_weight", "mix_block", "mix_row",
        F.expr(f"(mix_block * {period}) div _pf_q").alias("mix_release"),
        F.expr(f"((mix_block + 1) * {period} + _pf_q - 1) div _pf_q").alias("mix_deadline"),
        (F.expr(f"(mix_block div _pf_q) * {period}") + F.get("_pf_slots", F.expr("mix_block % _pf_q"))).alias("mix_slot"),
    )


def interleaved(mixed: DataFrame) -> DataFrame:
    """Rows in the order of the mix, cut into ranges of it: every file written from this is a mix itself."""
    return mixed.repartitionByRange("mix_slot", "mix_row").sortWithinPartitions("mix_slot", "mix_row")
