import hashlib

import pytest
from pyspark.sql import functions as F

from veritrail.operators import ordering


def expected_order(ids, seed=42):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("partitions", [1, 4, 16])
@pytest.mark.parametrize("digits", [1, 4])
def test_seeded_order_ignores_partitioning(spark, partitions, digits):
    df = spark.range(500).repartition(partitions)
    rows = ordering.with_seeded_ordinal(df, "id", digits=digits, total="n").orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(500))
    assert [r.id for r in rows] == expected_order(range(500))
    assert {r.n for r in rows} == {500}


def test_seeds_differ(spark):
    df = spark.range(50)
    a = [r.id for r in ordering.with_seeded_ordinal(df, "id", 1).orderBy("ordinal").collect()]
    b = [r.id for r in ordering.with_seeded_ordinal(df, "id", 2).orderBy("ordinal").collect()]
    assert a != b and sorted(a) == sorted(b)


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_range_order_with_a_hot_value(spark, partitions):
    # half of the rows share one value; the unique last column splits them
    df = spark.range(1000).withColumn("v", F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")))
    rows = ordering.with_range_ordinal(df.repartition(5), ["v", "id"], partitions=partitions).orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(1000))
    assert [(r.v, r.id) for r in rows] == sorted((r.v, r.id) for r in rows)


def test_shards_of_four(spark):
    df = ordering.with_seeded_ordinal(spark.range(9), "id")
    rows = df.select("ordinal", *ordering.shard_placement("ordinal", 4), ordering.sample_id("ordinal").alias("name")).orderBy("ordinal").collect()
    assert [r.shard_idx for r in rows] == [0, 0, 0, 0, 1, 1, 1, 1, 2]
    assert [r.local_idx for r in rows] == [0, 1, 2, 3, 0, 1, 2, 3, 0]
    assert rows[8].shard_file == "shard_0002.pt" and rows[8].name == "ex_000008"


@pytest.mark.parametrize("n,frac,val", [(15, 0.1, 1), (9, 0.1, 0), (10, 0.25, 2), (10, 0.0, 0), (0, 0.1, 0)])
def test_split_is_exact(spark, n, frac, val):
    rows = ordering.with_split(spark.range(n), "id", frac).collect()
    assert len(rows) == n
    assert sum(r.split == "val" for r in rows) == val
    # the validation rows are the first of the seeded order
    if val:
        assert {r.id for r in rows if r.split == "val"} == set(expected_order(range(n))[:val])


def test_split_by_original_keeps_groups_together(spark):
    df = spark.range(60).withColumn("g", F.col("id") % 20)
    rows = ordering.with_split(df, "id", 0.25, group_col="g").collect()
    sides = {}
    for r in rows:
        sides.setdefault(r.g, set()).add(r.split)
    assert all(len(s) == 1 for s in sides.values())
    assert sum(s == {"val"} for s in sides.values()) == 5


def test_epoch_batches(spark):
    def batches(epoch):
        rows = ordering.with_epoch_batches(spark.range(10), "id", 4, 42, epoch).collect()
        assert sorted([r.batch_id for r in rows].count(b) for b in (0, 1, 2)) == [2, 4, 4]
        return {r.id: r.batch_id for r in rows}

    assert batches(1) == batches(1) and batches(None) == batches(None)
    assert batches(1) != batches(2)


def test_early_stop_keeps_twelve_batches(spark):
    df = ordering.with_seeded_ordinal(spark.range(200), "id")
    assert ordering.early_stop(df, "ordinal").count() == 144


def test_running_start_over_gaps_and_ranges(spark):
    sizes = {k * 3: (k * 7) % 5 for k in range(400)} | {10**7: 2, 10**7 + 1: 0}
    df = spark.createDataFrame([(o, n or None, "x") for o, n in sizes.items()], "ordinal long, n int, other string").repartition(7)
    rows = ordering.with_running_start(df, "ordinal", "n", "start", slots=16, least=8).orderBy("ordinal").collect()
    total = 0
    for r in rows:
        assert r.start == total and r.other == "x"
        total += r.n or 0
    assert len(rows) == len(sizes)
    assert ordering.with_running_start(df.limit(0), "ordinal", "n", "start").count() == 0


def test_first_batches_are_those_of_the_whole_order(spark):
    df = spark.range(500).withColumn("v", F.col("id") * 2)
    whole = ordering.early_stop(ordering.with_seeded_ordinal(df, "id"), "ordinal")
    assert sorted(ordering.first_batches(df, "id").collect()) == sorted(whole.collect())
    assert ordering.first_batches(df.limit(5), "id").count() == 5 and ordering.first_batches(df.limit(0), "id").count() == 0


def test_scan_order_is_that_of_names(spark):
    df = spark.createDataFrame([(f"shard_{k:04d}.pt", j) for k in (2, 9999, 10000, 10001) for j in (1, 0)], "shard_file string, local_idx int")
    rows = ordering.scan_order(df).orderBy("scan_pos").collect()
    assert [(r.shard_file, r.local_idx) for r in rows] == sorted((r.shard_file, r.local_idx) for r in rows)
    assert [r.shard_file for r in rows][2] == "shard_10000.pt" and rows[-1].shard_file == "shard_9999.pt"
