"""Input records (JSON lines) and problem tables (CSV)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.functions.text import as_text, is_blank, strict_label, truthy
from veritrail.operators.ordering import with_range_ordinal

REQUIRED = ("question", "answer", "is_correct")


def read_records(spark: SparkSession, path: str, required: Sequence[str] = REQUIRED) -> DataFrame:
    """``(record_id, record VARIANT)`` per non-blank JSON line.

    Malformed JSON fails the job, and so does a record without one of the
    required keys; a key that is present with null passes. ``record_id`` is the
    position in file order: copies of one record keep ids of their own, so a
    seeded order spreads them.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line")
    )
    lines = lines.where(~is_blank("value"))
    keys = F.json_object_keys("value")
    absent = F.lit(False)
    for name in required:
        absent = absent | ~F.coalesce(F.array_contains(keys, name), F.lit(False))
    missing = lines.where(absent).count()
    if missing:
        raise ValueError(f"{missing} records lack one of the fields {', '.join(required)}")
    placed = with_range_ordinal(lines, ["_file", "_line"], "record_id")
    return placed.select("record_id", F.parse_json("value").alias("record"))


def record_columns(records: DataFrame, strict: bool = False) -> DataFrame:
    """``record_id, question, answer, label_correct, source`` from raw records."""
    raw = F.try_variant_get("record", "$.is_correct", "variant")
    return records.select(
        "record_id",
        as_text(F.try_variant_get("record", "$.question", "string")).alias("question"),
        as_text(F.try_variant_get("record", "$.answer", "string")).alias("answer"),
        (strict_label(raw) if strict else truthy(raw)).alias("label_correct"),
        F.try_variant_get("record", "$.source", "string").alias("source"),
    )


def read_problems(spark: SparkSession, path: str, column: str = "Question", first: int | None = None) -> DataFrame:
    """``(problem_idx, problem)`` in file order, optionally the first rows only."""
    table = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        .option("encoding", "UTF-8").csv(path)
        .select(
            F.col(column).alias("problem"),
            F.col("_metadata.file_path").alias("_file"),
            # a multi-line CSV file is read by one task, so this grows down the file
            F.monotonically_increasing_id().alias("_line"),
        )
    )
    if first is None:
        placed = with_range_ordinal(table, ["_file", "_line"], "problem_idx")
    else:
        head = table.orderBy("_file", "_line").limit(first)
        # ``first`` bounds this frame
        order = Window.orderBy("_file", "_line")
        placed = head.withColumn("problem_idx", (F.row_number().over(order) - 1).cast("long"))
    return placed.select("problem_idx", "problem")
