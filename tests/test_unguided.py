"""One draw per problem without guidance, and whole state shards in few files."""

from pathlib import Path

from pyspark.sql import functions as F

from veritrail.functions import tokens
from veritrail.plans import jobs


def test_unguided_reads_one_draw(spark):
    problems = spark.range(40).select(
        F.col("id").alias("problem_id"), F.concat(F.lit("problem "), "id").alias("problem"), (F.col("id") % 5).alias("batch_id")
    )
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def draw(_):
        import random

        calls.add(1)
        return "x " * random.randint(1, 200)

    def generate(rows):
        return rows.withColumn("chunk", draw.asNondeterministic()("problem_id"))

    got = jobs.unguided(problems, generate, tokens.hash_tokeniser(100)).collect()
    assert calls.value == 40 and len(got) == 40
    assert all(r["length"] <= r["padded_to"] for r in got)


def test_state_shards_are_few_files(spark, tmp_path):
    corpus = spark.range(400).select(
        F.col("id").cast("string").alias("id"), F.col("id").alias("ordinal"), F.array(F.lit(1), F.lit(2)).alias("ids")
    )

    class Encoder:
        def __call__(self, ids):
            import numpy as np

            return np.ones((len(ids), 2))

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        jobs.write_state_shards(corpus, str(tmp_path), Encoder, [], size=20)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    files = list(Path(tmp_path, "states").rglob("*.parquet"))
    assert spark.read.parquet(f"{tmp_path}/states").count() == 800
    assert len(files) <= 20 + int(spark.conf.get("spark.sql.shuffle.partitions"))
