import pytest
from pyspark.sql import functions as F

from veritrail.operators import skew, tree


@pytest.fixture(scope="module")
def facts(spark):
    # key 0 holds a third of all rows
    return spark.range(900).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 40 + 1))


def test_hot_keys(spark, facts):
    assert [r.k for r in skew.hot_keys(facts, ["k"], 300).collect()] == [0]
    assert skew.hot_keys(facts, ["k"], 301) is None


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot_rows", [5, 300, 10_000])
def test_lookup_join_equals_plain_join(spark, facts, how, hot_rows):
    lookup = spark.range(0, 30).select(F.col("id").alias("k"), (F.col("id") * 7).alias("v"))
    want = sorted(map(tuple, facts.join(lookup, ["k"], how).fillna(-1).collect()))
    got = skew.lookup_join(facts, lookup, ["k"], how, broadcast_bytes=0, hot_rows=hot_rows)
    assert sorted(map(tuple, got.fillna(-1).collect())) == want
    small = skew.lookup_join(facts, lookup, ["k"], how)
    assert sorted(map(tuple, small.fillna(-1).collect())) == want


@pytest.mark.parametrize("hot_rows", [5, 300, 10_000])
def test_group_stats(spark, facts, hot_rows):
    hot = skew.hot_keys(facts, ["k"], hot_rows)
    got = skew.attach_group_stats(facts, ["k"], {"n": F.count(F.lit(1)), "top": F.max("id")}, hot)
    want = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    assert sorted(map(tuple, got.select("k", "id", "n", "top").collect())) == sorted(
        map(tuple, facts.join(want, "k").select("k", "id", "n", "top").collect())
    )


def test_priors_are_the_same_for_hot_groups(spark, facts):
    df = facts.withColumn("logprob", -(F.col("id") % 11).cast("double"))
    plain = {r.id: r.prior for r in tree.sibling_priors(df, ["k"]).collect()}
    split = {r.id: r.prior for r in tree.sibling_priors(df, ["k"], hot_rows=50).collect()}
    assert plain.keys() == split.keys() and all(abs(plain[i] - split[i]) < 1e-12 for i in plain)
    sums = tree.sibling_priors(df, ["k"], hot_rows=50).groupBy("k").agg(F.sum("prior").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in sums)


def test_measured_bytes(spark):
    df = spark.createDataFrame([("ab", [1.0, 2.0]), (None, None)], "s string, v array<double>")
    assert 0 < skew.measured_bytes(df) < 100
    assert skew.measured_bytes(df.limit(0)) == 0
