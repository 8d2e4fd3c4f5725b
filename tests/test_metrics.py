import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.operators import metrics


def rows(spark, pairs, names="prob double, label int"):
    return spark.createDataFrame(pairs, names)


def test_threshold_is_strict(spark):
    r = metrics.classification_metrics(rows(spark, [(0.5, 1), (0.5, 0), (0.51, 1), (0.9, 0)])).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (1, 1, 1, 1)
    assert r.accuracy == pytest.approx(0.5) and r.f1 == pytest.approx(0.5)


@pytest.mark.parametrize("pairs", [[(0.1, 0)], []])
def test_no_positives_gives_zero_not_nan(spark, pairs):
    r = metrics.classification_metrics(rows(spark, pairs)).first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)
    assert r.accuracy == pytest.approx(1.0 if pairs else 0.0)


def test_loss_is_stable(spark):
    df = rows(spark, [(800.0, 0), (-800.0, 1), (0.0, 1), (2.0, 1)], "logit double, label int")
    got = [r.x for r in df.select(metrics.bce_with_logits("logit", "label").alias("x")).collect()]
    assert got[:2] == [800.0, 800.0]
    assert got[2] == pytest.approx(math.log(2)) and got[3] == pytest.approx(math.log1p(math.exp(-2)))


def test_epoch_loss_weighs_batches_alike(spark):
    z = np.linspace(-2, 2, 9)
    df = rows(spark, [(float(v), 1, i // 4) for i, v in enumerate(z)], "logit double, label int, batch_id int")
    bce = np.log1p(np.exp(-z))
    want = np.mean([bce[:4].mean(), bce[4:8].mean(), bce[8:].mean()])
    assert metrics.epoch_loss(df).first().loss == pytest.approx(want)


def test_skipped_batches_count_in_the_divisor(spark):
    df = rows(spark, [(0.0, 1, 0), (float("nan"), 1, 1)], "logit double, label int, batch_id int")
    r = metrics.epoch_loss(df).first()
    assert (r.n_batches, r.n_skipped) == (2, 1) and r.loss == pytest.approx(math.log(2) / 2)


@pytest.mark.parametrize("f1s,best,flags", [([0.0, 0.0, 0.0], None, [0, 0, 0]), ([0.5, 0.5], 1, [1, 0]), ([0.2, 0.1, 0.3], 3, [1, 0, 1])])
def test_best_epoch(spark, f1s, best, flags):
    df = rows(spark, [("r", i + 1, f) for i, f in enumerate(f1s)], "run string, epoch int, f1 double")
    assert metrics.best_epoch(df).first().best_epoch == best
    assert [int(r.is_new_best) for r in metrics.with_best_so_far(df).orderBy("epoch").collect()] == flags


def test_cosine_rate(spark):
    df = spark.range(0, 11).select(metrics.cosine_rate(F.col("id"), F.lit(10), 1e-3).alias("lr"))
    rates = [r.lr for r in df.collect()]
    assert rates[0] == pytest.approx(1e-3) and rates[-1] == pytest.approx(1e-4) and rates[5] == pytest.approx(5.5e-4)


def test_evaluate(spark):
    df = spark.range(10).select("id", ((F.col("id") - 5) / 2.0).alias("logit"), (F.col("id") % 2).alias("label"))
    df = df.withColumn("prob", 1 / (1 + F.exp(-F.col("logit"))))
    r = metrics.evaluate(df, "id", 4).first()
    assert r.tp + r.fp + r.tn + r.fn == 10 and r.loss > 0
