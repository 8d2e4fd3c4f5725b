"""Reading the given tables and casting them in the roles of the search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions.tokens import split_tokens
from veritrail.operators.ordering import with_seeded_ordinal
from veritrail.operators.skew import attach_group_stats, hot_keys
from veritrail.session import spread, written_table

FIRST_DAY = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed(salt: str, *cols: str) -> Column:
    """Non-negative 32-bit number from md5 of ``salt:col[:col...]``."""
    text = F.concat_ws(":", F.lit(salt), *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def dialogue(spark: SparkSession, sf_dir: str, answered: bool) -> DataFrame:
    """User turns with the assistant turn that follows.

    Turns meet on ``(conv_id, turn)``, so a very long conversation spreads.
    """
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    if not answered:
        return asked
    replies = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(replies, ["conv_id", "turn"])


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a label, as question/answer records."""
    docs = spread(table(spark, sf_dir, "documents")).select(
        "doc_id", F.concat("source", "lang").alias("question"), F.col("text").alias("answer"), "lang", "source"
    )
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label_correct"))
    return docs.join(labels, "doc_id")


def document_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.size(split_tokens("text")).alias("length"))


def candidate_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as logged candidates: a user is a problem, a day an iteration."""
    day = F.datediff(F.to_date("ts"), F.lit(FIRST_DAY).cast("date"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("problem_id"), day.alias("iter"), F.col("event_id").alias("cand_idx"),
        F.concat("event_type", F.lit(" ")).alias("chunk"),
        F.round(F.least(F.col("value") / 100, F.lit(1.0)), 6).alias("score"),
        (F.col("event_type") == "error").alias("eos"),
    )


def sentence_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every document, numbered in seeded order."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    parts = docs.select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("part", "sentence"))
    numbered = with_seeded_ordinal(parts, ["doc_id", "part"], "pool", "pool_idx")
    return numbered.select("pool_idx", F.concat("sentence", F.lit(". ")).alias("chunk"))


def commerce_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree per region: nations, customers and orders below it.

    A node's visits are the line items beneath it, its value their discounts;
    siblings share the prior evenly.
    """
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("visits"), F.sum("l_discount").alias("value_sum")
    )
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    places = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    placed = places.join(nations, "n_nationkey")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("c_custkey"), (F.col("o_orderstatus") == "F").alias("eos")
    )
    totals = [F.sum("visits").alias("visits"), F.sum("value_sum").alias("value_sum")]
    known = {"visits": 0, "value_sum": 0.0}
    ordered = orders.join(items, "o_orderkey", "left").fillna(known)
    leaves = ordered.join(placed, "c_custkey")
    customers = placed.join(ordered.groupBy("c_custkey").agg(*totals), "c_custkey", "left").fillna(known)
    lands = nations.join(customers.groupBy("n_nationkey").agg(*totals), "n_nationkey", "left").fillna(known)
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"))
    regions = regions.join(lands.groupBy("n_regionkey").agg(*totals), "n_regionkey", "left").fillna(known)

    def named(kind: str, key: str) -> Column:
        return F.concat(F.lit(kind), F.col(key).cast("string"))

    def level(rows: DataFrame, kind: str, key: str, parent: Column, depth: int, eos: Column) -> DataFrame:
        return rows.select(
            F.col("n_regionkey").cast("int").alias("tree_id"), named(kind, key).alias("node_id"),
            parent.alias("parent_id"), F.col(key).cast("long").alias("child_ord"), F.lit(depth).alias("depth"),
            eos.alias("eos"), F.lit(False).alias("terminal"), F.col("visits").cast("long").alias("visits"),
            F.col("value_sum").cast("double").alias("value_sum"),
        )

    no = F.lit(False)
    levels = (
        level(regions, "r", "n_regionkey", F.lit(None).cast("string"), 0, no)
        .unionByName(level(lands, "n", "n_nationkey", named("r", "n_regionkey"), 1, no))
        .unionByName(level(customers, "c", "c_custkey", named("n", "n_nationkey"), 2, no))
        .unionByName(level(leaves, "o", "o_orderkey", named("c", "c_custkey"), 3, F.col("eos")))
    )
    # the joins above run once, then the node table is read as any stored tree
    nodes = written_table(levels, "tree")
    family = ["tree_id", "parent_id"]
    counted = attach_group_stats(nodes, family, {"_n": F.count(F.lit(1))}, hot_keys(nodes, family))
    return counted.withColumn("prior", F.lit(1.0) / F.col("_n")).drop("_n")
