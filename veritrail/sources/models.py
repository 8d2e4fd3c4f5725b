"""Grader checkpoints and training history as tables."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions import grader_math as gm
from veritrail.operators.grade import Grader
from veritrail.operators.training import TrainResult

KEPT_VERSIONS = 2
SCHEMA = (
    "run string, epoch int, best_f1 double, part string, param_name string, "
    "shape array<int>, values array<double>, args map<string,string>"
)


def checkpoint_rows(
    run: str, epoch: int, grader: Grader, optimiser: gm.AdamW | None = None, best_f1: float | None = None
) -> list[tuple]:
    args = grader.spec.to_args()
    groups = {"weight": grader.params, "running": grader.running}
    if optimiser:
        groups["adam_mean"], groups["adam_square"] = optimiser.mean, optimiser.square
        groups["adam_step"] = {"step": np.array([float(optimiser.step)])}
    return [
        (run, epoch, best_f1, part, name, list(map(int, w.shape)), w.ravel().tolist(), args)
        for part, params in groups.items()
        for name, w in params.items()
    ]


def save_checkpoint(
    spark: SparkSession, path: str, run: str, epoch: int, grader: Grader,
    optimiser: gm.AdamW | None = None, best_f1: float | None = None,
) -> None:
    """Add a version to the checkpoint at ``path``; only weights pass the driver.

    A version is a folder of its own, whole once its commit marker stands. The
    newest ``KEPT_VERSIONS`` whole ones stay, so that a failure at any point
    leaves one to load; older ones go.
    """
    rows = spark.createDataFrame(checkpoint_rows(run, epoch, grader, optimiser, best_f1), SCHEMA)
    rows.coalesce(1).write.parquet(f"{path}/saved_at={time.time_ns():020d}")
    for old in versions(spark, path)[:-KEPT_VERSIONS]:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of the whole versions of a checkpoint, oldest first."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/saved_at=*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(f.getPath().getParent().toString() for f in found or [])


def checkpoint_saver(spark: SparkSession, folder: str):
    """``on_epoch`` hook: ``best`` on each F1 gain, ``last`` after every epoch."""

    def on_epoch(run: str, epoch: int, grader: Grader, optimiser: gm.AdamW, is_best: bool, f1: float) -> None:
        if is_best:
            save_checkpoint(spark, f"{folder}/{run}/best", run, epoch, grader, optimiser, f1)
        save_checkpoint(spark, f"{folder}/{run}/last", run, epoch, grader, optimiser)

    return on_epoch


def load_grader(spark: SparkSession, path: str, in_dim: int | None = None) -> Grader:
    """Rebuild a grader from the newest version of its checkpoint; absent arguments take defaults."""
    whole = versions(spark, path)
    if not whole:
        raise FileNotFoundError(f"no whole checkpoint in {path}")
    rows = spark.read.schema(SCHEMA).parquet(whole[-1]).where(F.col("part").isin("weight", "running")).collect()
    parts: dict[str, gm.Params] = {"weight": {}, "running": {}}
    for r in rows:
        parts[r["part"]][r["param_name"]] = np.asarray(r["values"]).reshape(r["shape"])
    return Grader(gm.GraderSpec.from_args(rows[0]["args"], in_dim), parts["weight"], parts["running"])


def write_history(result: TrainResult, path: str) -> None:
    result.history.coalesce(1).write.mode("overwrite").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    from veritrail.operators.training import HISTORY

    return spark.read.schema(HISTORY).json(path)
