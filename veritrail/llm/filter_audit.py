"""How quality filters interact, whatever their order (operator 13).

Spark reduces the corpus to one count per part and per pattern of failures: 32
numbers a part, which are a 2 x 2 x 2 x 2 x 2 contingency tensor with one axis
for each filter (0: passes, 1: fails). Everything an order of filters does is a
contraction of that tensor: along each axis a step selects what passes, what
fails, or all. The tensors of a batch of parts are contracted together by one
einsum over all orders and steps.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.llm.common import python_ready
from veritrail.operators.skew import lookup_join

FILTERS = "ABCDE"
ORDERS = ["".join(order) for order in itertools.permutations(FILTERS)]
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
OUT = "part string, filter_order string, step int, " + ", ".join(f"{name} bigint" for name in COUNTS)
#: parts that are contracted together; a part gives 600 rows
PARTS = 64

WORD_GAP = r"[\x20\x09-\x0D]+"
MIN_WORDS = 200


def text_failures(text: Column) -> Column:
    """Failures of the four filters that see one text, as bits: A 16, B 8, C 4, D 2."""
    words = F.array_remove(F.split(text, WORD_GAP), "")
    # a transform over one element holds its value, so the text is split once
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("kinds"))).getItem(0)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))

    def bits(c: Column) -> Column:
        # A and B as one expression of the held counts
        short = (c["n"] < MIN_WORDS).cast("int") * 16
        return short + (c["kinds"].cast("long") * 100 < c["n"].cast("long") * 50).cast("int") * 8

    loud = (capitals.cast("long") * 100 > F.length(text).cast("long") * 3).cast("int") * 4
    return F.transform(F.array(counts), bits).getItem(0) + loud + text.rlike(r"[#$%&*|]").cast("int") * 2


def flag_rows(labels: DataFrame) -> DataFrame:
    """``_id, _good, _toxic`` of ids with either flag; several label rows of an id count together."""
    flags = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("_good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("_toxic"),
    )
    return flags.where(F.col("_good") | F.col("_toxic"))


def tensor_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents of each part by their five failures.

    Rows are narrowed to a hash of the text, id, part and failures before any
    shuffle. Copies of a text are counted, never gathered: the smallest id and
    its count come from aggregates that combine on the map side, so a text that
    a third of all rows share costs a row per task.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.unhex(F.sha2(text, 256)).alias("_h"), F.coalesce(F.col("lang"), F.lit("")).alias("part"),
        F.col("doc_id").alias("_doc"), text_failures(text).alias("_bits"),
    )
    counted = rows.groupBy("_h", "part", "_doc", "_bits").agg(F.count(F.lit(1)).alias("_n"))
    # rows without an id have no label; their keys are spread, and the flags are undone below
    keyed = counted.withColumn("_id", F.coalesce("_doc", F.xxhash64("_h", "part")))
    met = lookup_join(keyed, flag_rows(labels), ["_id"], "left")

    def flagged(flag: str) -> Column:
        known = F.col("_doc").isNotNull() & F.coalesce(F.col(flag), F.lit(False))
        return F.when(known, F.col("_n")).otherwise(F.lit(0).cast("long"))

    known = met.select("_h", "part", "_bits", "_doc", "_n", flagged("_good").alias("_g"), flagged("_toxic").alias("_t"))
    sums = [F.sum(c).alias(c) for c in ("_n", "_g", "_t")]
    first = F.min(F.when(F.col("_doc").isNotNull(), F.struct("_doc", "_n", "_g", "_t"))).alias("_first")
    nameless = F.sum(F.when(F.col("_doc").isNull(), F.col("_n")).otherwise(F.lit(0))).alias("_none")
    groups = known.groupBy("_h", "part", "_bits").agg(*sums, first, nameless)
    # rows of a window are the parts that share one text
    lowest = F.min("_first._doc").over(Window.partitionBy("_h"))
    placed = groups.withColumn("_leads", F.coalesce(F.col("_first._doc") == lowest, F.lit(False)))

    def leading(name: str) -> Column:
        return F.when(F.col("_leads"), F.col(f"_first.{name}")).otherwise(F.lit(0).cast("long"))

    passing = F.struct(
        F.col("_bits").alias("mask"), (leading("_n") + F.col("_none")).alias("n"), leading("_g").alias("good"), leading("_t").alias("toxic")
    )
    failing = F.struct(
        (F.col("_bits") + 1).alias("mask"), (F.col("_n") - leading("_n") - F.col("_none")).alias("n"),
        (F.col("_g") - leading("_g")).alias("good"), (F.col("_t") - leading("_t")).alias("toxic"),
    )
    both = placed.select("part", F.explode(F.array(passing, failing)).alias("_c")).select("part", "_c.*")
    return both.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def selections() -> dict[str, np.ndarray]:
    """What each step of each order takes along each axis: ``[order and step, filter, pass or fail]``."""
    kinds: dict[str, list] = {"kept": [], "removed": [], "fails": [], "unique": []}
    for order in ORDERS:
        for step, own in enumerate(order):
            before = set(order[:step])
            kinds["kept"].append([PASS if f in before or f == own else ALL for f in FILTERS])
            kinds["removed"].append([FAIL if f == own else PASS if f in before else ALL for f in FILTERS])
            kinds["fails"].append([FAIL if f == own else ALL for f in FILTERS])
            kinds["unique"].append([FAIL if f == own else PASS for f in FILTERS])
    return {name: np.array(rows, dtype=np.int64) for name, rows in kinds.items()}


def contract(tensors: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Counts ``[part, selection]`` of tensors ``[part, 2, 2, 2, 2, 2]``."""
    axes = [chosen[:, k] for k in range(len(FILTERS))]
    return np.einsum("pabcde,sa,sb,sc,sd,se->ps", tensors, *axes, optimize="greedy")


def audit_tensors(parts: list[str], n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> pd.DataFrame:
    """All orders and steps of some parts; the arrays are ``[part, 32]``."""
    pick = selections()
    whole, fine, bad = (x.reshape(-1, 2, 2, 2, 2, 2) for x in (n, good, toxic))
    removed = contract(whole, pick["removed"])
    own = np.array([FILTERS.index(f) for order in ORDERS for f in order])
    # a filter's removals over all orders, whatever the step
    shapley = np.stack([removed[:, own == k].sum(axis=1) for k in range(len(FILTERS))], axis=1)[:, own]
    found = {
        "kept": contract(whole, pick["kept"]), "removed": removed, "redundant": contract(whole, pick["fails"]) - removed,
        "unique_fails": contract(whole, pick["unique"]), "good_lost": contract(fine, pick["removed"]),
        "toxic_lost": contract(bad, pick["removed"]), "shapley": shapley,
    }
    steps = len(own)
    return pd.DataFrame(
        {
            "part": np.repeat(np.array(parts, dtype=object), steps),
            "filter_order": [order for _ in parts for order in ORDERS for _ in FILTERS],
            "step": np.tile(np.arange(steps, dtype=np.int32) % len(FILTERS) + 1, len(parts)),
            **{name: values.ravel() for name, values in found.items()},
        }
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of five filters in all 120 orders, one row for each part, order and step.

    ``docs`` needs ``doc_id, text, lang``, ``labels`` needs ``doc_id, quality,
    toxic``; other columns, whatever their names, are not read. A null text is
    empty; a null ``lang`` and an empty one are the part ''. E fails a document
    whose text a smaller id has anywhere in the table: rows with the smallest
    id pass it, repeated ones too, and so do rows without an id, which fail no
    other row and have no label. An id with several label rows is good or toxic
    if one of them says so. An empty table has no parts and gives no rows.
    """
    python_ready(docs.sparkSession)
    counts = tensor_counts(docs, labels)
    # at most 32 entries to a part
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), PARTS):
                some = pdf.iloc[start : start + PARTS]
                tables = np.zeros((3, len(some), 32), dtype=np.int64)
                for row, entries in enumerate(some["cells"]):
                    for cell in entries:
                        tables[:, row, cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
                yield audit_tensors(some["part"].tolist(), *tables)

    return cells.mapInPandas(run, OUT)


#: The same counts for DuckDB: every document against every order, without tensors.
AUDIT_SQL = """
WITH rows AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
flags AS (
  SELECT part, doc_id, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
  FROM rows),
marks AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
docs AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
    || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END) AS failed,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM flags LEFT JOIN marks USING (doc_id)),
kinds AS (SELECT part, failed, good, toxic, count(*) AS n FROM docs GROUP BY ALL),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM f p, f q, f r, f s, f t
  WHERE p.x NOT IN (q.x, r.x, s.x, t.x) AND q.x NOT IN (r.x, s.x, t.x) AND r.x NOT IN (s.x, t.x) AND s.x <> t.x),
steps AS (SELECT filter_order, i AS step, filter_order[i] AS own, filter_order[1 : i - 1] AS before FROM orders, range(1, 6) g(i)),
met AS (
  SELECT k.part, s.filter_order, s.step, s.own, k.n, k.good, k.toxic, contains(k.failed, s.own) AS fails,
    k.failed = s.own AS only_this, regexp_matches(k.failed, '[' || s.before || '.]') AS gone
  FROM kinds k, steps s),
counts AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (only_this), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (NOT gone AND fails AND good), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (NOT gone AND fails AND toxic), 0)::BIGINT AS toxic_lost
  FROM met GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counts"""
