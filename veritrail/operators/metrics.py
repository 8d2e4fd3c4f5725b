"""Classification metrics and losses as single-pass aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPS = 1e-8


def confusion_counts(prob: str, label: str, threshold: float = 0.5) -> list[Column]:
    hit = F.col(prob) > F.lit(threshold)
    good = F.col(label).cast("int") == 1
    cells = {"tp": hit & good, "fp": hit & ~good, "tn": ~hit & ~good, "fn": ~hit & good}
    return [F.count_if(cond).cast("long").alias(name) for name, cond in cells.items()]


def with_rates(df: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from the four counts; never NaN."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    rated = df.withColumns(
        {
            "accuracy": (tp + tn) / (tp + tn + fp + fn + EPS),
            "precision": tp / (tp + fp + EPS),
            "recall": tp / (tp + fn + EPS),
        }
    )
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", F.lit(2.0) * p * r / (p + r + EPS))


def classification_metrics(
    df: DataFrame, prob: str = "prob", label: str = "label", by: Sequence[str] = (), threshold: float = 0.5
) -> DataFrame:
    return with_rates(df.groupBy(*by).agg(*confusion_counts(prob, label, threshold)))


def bce_with_logits(logit: str | Column, label: str | Column) -> Column:
    """Cross-entropy of one row, stable for large logits of either sign."""
    z = F.col(logit) if isinstance(logit, str) else logit
    y = F.col(label) if isinstance(label, str) else label
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def epoch_loss(df: DataFrame, logit: str = "logit", label: str = "label", batch: str = "batch_id") -> DataFrame:
    """Mean over batches of batch means; non-finite batches count in the divisor only."""
    means = df.groupBy(batch).agg(F.avg(bce_with_logits(logit, label)).alias("batch_loss"))
    finite = ~F.isnan("batch_loss") & (F.abs("batch_loss") < F.lit(float("inf")))
    return means.agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.count_if(~finite).alias("n_skipped"),
        (F.sum(F.when(finite, F.col("batch_loss")).otherwise(0.0)) / F.count(F.lit(1))).alias("loss"),
    )


def evaluate(
    scored: DataFrame, id_cols: str | Sequence[str], batch_size: int, seed: int = 42, epoch: int | None = None
) -> DataFrame:
    """Loss and metrics of a scored table in one row."""
    from veritrail.operators.ordering import with_epoch_batches

    batched = with_epoch_batches(scored, id_cols, batch_size, seed, epoch)
    per_batch = batched.groupBy("batch_id").agg(
        F.avg(bce_with_logits("logit", "label")).alias("batch_loss"), *confusion_counts("prob", "label")
    )
    totals = [F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "tn", "fn")]
    return with_rates(per_batch.agg(F.avg("batch_loss").alias("loss"), *totals))


def with_best_so_far(history: DataFrame, f1: str = "f1", epoch: str = "epoch", run: str = "run") -> DataFrame:
    """Flag epochs whose F1 beats every earlier one and zero.

    The window holds one run's epochs, a number set by the job.
    """
    earlier = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    best = F.greatest(F.coalesce(F.max(f1).over(earlier), F.lit(0.0)), F.lit(0.0))
    return history.withColumn("best_before", best).withColumn("is_new_best", F.col(f1) > F.col("best_before"))


def best_epoch(history: DataFrame, f1: str = "f1", epoch: str = "epoch", run: str = "run") -> DataFrame:
    """Earliest epoch of the highest F1 per run; null where F1 never exceeds 0."""
    pick = F.max_by(epoch, F.when(F.col(f1) > 0, F.struct(F.col(f1), -F.col(epoch))))
    top = F.max(F.when(F.col(f1) > 0, F.col(f1)))
    return history.groupBy(run).agg(pick.alias("best_epoch"), top.alias("best_f1"))


def cosine_rate(epoch: Column, epochs: Column, rate: float) -> Column:
    """Learning rate after the given epoch; ends at a tenth of ``rate``."""
    floor = F.lit(0.1 * rate)
    return floor + (F.lit(rate) - floor) * (F.lit(1.0) + F.cos(F.lit(3.141592653589793) * epoch / epochs)) / 2
