"""Distributed training of linear graders.

Steps follow one another. Those of few rows are taken chunk by chunk: one task
reads a chunk of bounded size and takes all its steps, and weights, moments and
sums of the run travel on to the next chunk. A step wider than a chunk, or that
is all of an epoch, is one job of aggregates over the rows of its batches:
losses, counts and gradients combine on executors, no row is shuffled, and the
driver sees one row of ``width + 1`` sums. Clipping, AdamW and the cosine rate
act on those few numbers in both. Runs of a sweep share the split and the epoch
tables.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.functions import grader_math as gm
from veritrail.functions.vectors import as_double, bind, dot, sigmoid, width_check
from veritrail.operators import metrics
from veritrail.operators.grade import Grader, linear_grader, score
from veritrail.operators.ordering import with_epoch_batches, with_split
from veritrail.session import drop_scratch, scratch_path, ship_package, written_table

#: bytes of vectors in a chunk of an epoch table, which one task holds and steps through
CHUNK_BYTES = 1 << 24
CELLS = ("tp", "fp", "tn", "fn")
#: settings that runs of one sweep have in common, since they share batches
SHARED = ("val_split", "batch_size", "epochs", "seed", "split_by")


@dataclass(frozen=True)
class TrainConfig:
    val_split: float = 0.1
    batch_size: int = 32
    epochs: int = 10
    learning_rate: float = 1e-3
    weight_decay: float = 0.01
    grad_clip: float = 1.0
    accumulation_steps: int = 64
    #: batches to an update step where it differs from the divisor of their gradients; 0: all of an epoch
    step_batches: int | None = None
    seed: int = 42
    split_by: str | None = None


@dataclass
class Prepared:
    """Split vectors in the shared folder."""

    config: TrainConfig
    train: DataFrame
    val: DataFrame | None
    n_train: int
    in_dim: int
    paths: list[str]

    @property
    def n_batches(self) -> int:
        return math.ceil(self.n_train / self.config.batch_size)

    @property
    def chunk_batches(self) -> int:
        """Batches to a chunk of an epoch table."""
        return max(1, CHUNK_BYTES // (4 * max(1, self.in_dim) * self.config.batch_size))

    @contextmanager
    def epoch_rows(self, epoch: int) -> Iterator[DataFrame]:
        """Rows reshuffled for the epoch, in chunks of batches; removed once its steps are done.

        Every chunk is a folder, so a filter on ``chunk`` opens no other file.
        """
        batched = with_epoch_batches(self.train, "id", self.config.batch_size, self.config.seed, epoch)
        batched = batched.select("vec", "label", "batch_id", F.expr(f"batch_id div {self.chunk_batches}").alias("chunk"))
        spark = batched.sparkSession
        path = scratch_path(spark, f"epoch{epoch}")
        try:
            yield written_table(batched.repartition("chunk"), f"epoch{epoch}", "chunk", path=path)
        finally:
            drop_scratch(spark, path)

    def close(self) -> None:
        """Remove the split vectors; the result of the training does not need them."""
        while self.paths:
            drop_scratch(self.train.sparkSession, self.paths.pop())


def prepare(df: DataFrame, config: TrainConfig, id_col: str = "id", vec: str = "vec", label: str = "label") -> Prepared:
    """Split ``df`` once and store both sides; a missing label or vector, or an uneven width, is an error."""
    spark = df.sparkSession
    unlabelled = F.raise_error(F.lit("training rows must have a label")).cast("double")
    rows = df.select(
        F.col(id_col).alias("id"),
        *([F.col(config.split_by).alias("_group")] if config.split_by else []),
        F.col(vec).cast("array<float>").alias("vec"),
        F.coalesce(F.col(label).cast("double"), unlabelled).alias("label"),
    )
    group = "_group" if config.split_by else None
    placed = with_split(rows, "id", config.val_split, config.seed, group_col=group).drop("_group")
    paths = [scratch_path(spark, "vectors"), scratch_path(spark, "val")]
    table = written_table(placed, "vectors", "split", path=paths[0])
    train = table.where(F.col("split") == "train").drop("split")
    facts = width_check(train).first()
    if not facts["n_rows"] or facts["n_missing"] or facts["min_width"] != facts["max_width"]:
        raise ValueError("training vectors must all be present and of one width")
    val = None
    if config.val_split > 0:
        val = table.where(F.col("split") == "val").drop("split")
        val = written_table(with_epoch_batches(val, "id", config.batch_size, config.seed, None), "val", path=paths[1])
    return Prepared(config, train, val, facts["n_rows"], facts["min_width"], paths)


@dataclass
class _Run:
    config: TrainConfig
    params: gm.Params
    optimiser: gm.AdamW
    carried: np.ndarray | None = None
    best: Grader | None = None
    best_epoch: int | None = None
    best_f1: float = 0.0

    def weights(self) -> np.ndarray:
        """Weights with the bias last."""
        return np.concatenate([self.params["out.w"][0], self.params["out.b"]])

    def grader(self) -> Grader:
        return linear_grader(self.params["out.w"][0].copy(), float(self.params["out.b"][0]))


@dataclass
class TrainResult:
    history: DataFrame
    best: dict[str, Grader | None]
    last: dict[str, Grader]
    best_epoch: dict[str, int | None]
    best_f1: dict[str, float]
    optimisers: dict[str, gm.AdamW]


def step_sums(rows: DataFrame, weights: np.ndarray, accumulation: int) -> DataFrame:
    """One row of sums over the batches of a step: gradient, loss and confusion counts.

    ``weights`` has the bias last. A batch whose loss is not finite adds
    nothing; ``ends_finite`` tells whether the last batch is finite.
    """
    inputs = rows.select("batch_id", "label", F.concat(as_double(F.col("vec")), F.array(F.lit(1.0))).alias("x"))
    # one literal that Catalyst folds to an array: a step is planned as fast for wide vectors as for narrow ones
    constant = F.split(F.lit(",".join(repr(float(w)) for w in weights)), ",").cast("array<double>")
    scored = inputs.withColumn("z", dot(F.col("x"), constant)).withColumn("prob", sigmoid(F.col("z")))
    slope = bind(F.col("prob") - F.col("label"), lambda d: F.transform("x", lambda v: v * d))
    per_batch = scored.groupBy("batch_id").agg(
        F.avg(metrics.bce_with_logits("z", "label")).alias("loss"),
        Summarizer.mean(array_to_vector(slope)).alias("g"),
        *metrics.confusion_counts("prob", "label"),
    )
    per_batch = per_batch.withColumn("finite", ~F.isnan("loss") & (F.abs("loss") < F.lit(float("inf"))))
    share = F.transform(vector_to_array(F.col("g")), lambda v: F.when(F.col("finite"), v / accumulation).otherwise(0.0))

    def kept(name: str):
        return F.sum(F.when(F.col("finite"), F.col(name)).otherwise(0)).alias(name)

    return per_batch.agg(
        vector_to_array(Summarizer.sum(array_to_vector(share))).alias("grad"),
        *[kept(c) for c in ("loss", *CELLS)],
        F.max_by("finite", "batch_id").alias("ends_finite"),
    )


def apply_step(run: _Run, grad: np.ndarray, ends_finite: bool, rate: float) -> None:
    """Add a step's gradient and update; a skipped last batch skips the update and the gradient carries over."""
    run.carried = grad if run.carried is None else run.carried + grad
    if not ends_finite:
        return
    split = {"out.w": run.carried[None, :-1], "out.b": run.carried[-1:]}
    run.params = run.optimiser.update(run.params, gm.clip_by_norm(split, run.config.grad_clip), rate)
    run.carried = None


def _rates(tp: float, fp: float, tn: float, fn: float) -> dict:
    tp, fp, tn, fn = (float(v) for v in (tp, fp, tn, fn))
    accuracy = (tp + tn) / (tp + tn + fp + fn + metrics.EPS)
    precision, recall = tp / (tp + fp + metrics.EPS), tp / (tp + fn + metrics.EPS)
    f1 = 2 * precision * recall / (precision + recall + metrics.EPS)
    return dict(
        accuracy=accuracy, precision=precision, recall=recall, f1=f1,
        tp=int(tp), fp=int(fp), tn=int(tn), fn=int(fn),
    )


def _validate(val: DataFrame, grader: Grader) -> tuple[float, dict]:
    per_batch = score(val, grader).groupBy("batch_id").agg(
        F.avg(metrics.bce_with_logits("logit", "label")).alias("batch_loss"),
        *metrics.confusion_counts("prob", "label"),
    )
    row = per_batch.agg(F.avg("batch_loss"), *[F.sum(c) for c in CELLS]).first()
    return row[0], _rates(*[v or 0 for v in row[1:]])


RATES = "struct<accuracy:double,precision:double,recall:double,f1:double,tp:long,fp:long,tn:long,fn:long>"
HISTORY = (
    f"run string, epoch int, train_loss double, train_metrics {RATES}, lr double, "
    f"val_loss double, val_metrics {RATES}"
)


def rate_after(config: TrainConfig, epoch: int) -> float:
    """Learning rate after ``epoch`` epochs: a cosine from the full rate to a tenth of it."""
    floor = 0.1 * config.learning_rate
    return floor + (config.learning_rate - floor) * (1 + math.cos(math.pi * epoch / config.epochs)) / 2


def _steps_of_rows(run: _Run, rows: pa.Table, size: int, n_batches: int, rate: float) -> tuple[float, np.ndarray]:
    """Update steps of ``size`` batches over the rows of a chunk, in any order.

    A step that goes on in the next chunk leaves its gradient in the run. Losses
    and confusion counts are those before each update.
    """
    vec = rows["vec"].combine_chunks().flatten()
    if vec.null_count:
        raise ValueError("training vectors must not have missing numbers")
    order = np.argsort(rows["batch_id"].to_numpy(), kind="stable")
    batch, label, good = (rows[c].to_numpy()[order] for c in ("batch_id", "label", "good"))
    x = vec.to_numpy(zero_copy_only=False).reshape(len(batch), -1)[order]
    # first row of every batch, and first batch of every step
    starts = np.flatnonzero(np.diff(batch, prepend=-1))
    firsts = np.flatnonzero(np.diff(batch[starts] // size, prepend=-1))
    loss, cells = 0.0, np.zeros(len(CELLS))
    for own in np.split(starts, firsts[1:]):
        last = int(batch[own[-1]])
        at = slice(own[0], np.searchsorted(batch, last, "right"))
        grad, part, counts, ends_finite = gm.batch_sums(x[at], label[at], good[at], own - own[0], run.weights(), run.config.accumulation_steps)
        whole = (last + 1) % size == 0 or last + 1 == n_batches
        apply_step(run, grad, whole and ends_finite, rate)
        loss += part
        cells += counts
    return loss, cells


def _chunk_of(run: _Run, rows: DataFrame, size: int, n_batches: int, rate: float) -> tuple[float, np.ndarray]:
    """All update steps of a chunk in one task, which hands back the state of the run."""
    ship_package(rows.sparkSession)
    sent = _Run(run.config, run.params, run.optimiser, run.carried)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _steps_of_rows(sent, pa.Table.from_batches(batches), size, n_batches, rate)
        yield pa.RecordBatch.from_pydict({"state": [pickle.dumps((sent.params, sent.optimiser, sent.carried, *sums))]})

    narrow = rows.select("batch_id", "label", (F.col("label").cast("int") == 1).alias("good"), "vec")
    state = narrow.coalesce(1).mapInArrow(walk, "state binary").collect()[0]["state"]
    run.params, run.optimiser, run.carried, loss, cells = pickle.loads(state)
    return loss, cells


def _epoch_of(run: _Run, rows: DataFrame, n_batches: int, chunk_batches: int, rate: float) -> tuple[float, np.ndarray]:
    """All update steps of an epoch; the mean batch loss and the confusion counts before each update."""
    config = run.config
    size = config.accumulation_steps if config.step_batches is None else config.step_batches or n_batches
    loss, cells = 0.0, np.zeros(len(CELLS))
    if size < min(n_batches, chunk_batches):
        for chunk in range(math.ceil(n_batches / chunk_batches)):
            part, counts = _chunk_of(run, rows.where(F.col("chunk") == chunk), size, n_batches, rate)
            loss += part
            cells += counts
        return loss / n_batches, cells
    for first in range(0, n_batches, size):
        last = first + size - 1
        step = rows.where(F.col("chunk").between(first // chunk_batches, last // chunk_batches) & F.col("batch_id").between(first, last))
        sums = step_sums(step, run.weights(), config.accumulation_steps).first()
        apply_step(run, np.asarray(sums["grad"]), sums["ends_finite"], rate)
        loss += sums["loss"]
        cells += [sums[c] for c in CELLS]
    return loss / n_batches, cells


def train_graders(
    prepared: Prepared, configs: dict[str, TrainConfig], initial: gm.Params | None = None, on_epoch=None
) -> TrainResult:
    """Fit one linear grader per configuration on the same batches.

    ``on_epoch(run, epoch, grader, optimiser, is_best, f1)`` is called after
    every epoch, for instance to store checkpoints.
    """
    base = prepared.config
    for name, config in configs.items():
        if any(getattr(config, f) != getattr(base, f) for f in SHARED):
            raise ValueError(f"{name} differs from the prepared vectors in one of {', '.join(SHARED)}")
    spec = gm.GraderSpec(in_dim=prepared.in_dim, hidden_dims=(), dropout=0.0)
    start = initial or gm.init_params(spec, base.seed)
    runs = {name: _Run(c, dict(start), gm.AdamW(c.weight_decay)) for name, c in configs.items()}
    history: list[tuple] = []
    for epoch in range(1, base.epochs + 1):
        # runs of an epoch do not depend on each other: their chunks and tests are short jobs side by side
        with prepared.epoch_rows(epoch) as rows, ThreadPoolExecutor(len(runs)) as pool:
            sizes = prepared.n_batches, prepared.chunk_batches
            steps = {name: pool.submit(_epoch_of, run, rows, *sizes, rate_after(run.config, epoch - 1)) for name, run in runs.items()}
            done = {name: step.result() for name, step in steps.items()}
            tests = {name: pool.submit(_validate, prepared.val, run.grader()) for name, run in runs.items() if prepared.val is not None}
            tested = {name: test.result() for name, test in tests.items()}
        for name, run in runs.items():
            loss, cells = done[name]
            train_rates = _rates(*cells)
            val_loss, val_rates = tested.get(name, (None, None))
            history.append((name, epoch, loss, train_rates, rate_after(run.config, epoch), val_loss, val_rates))
            f1 = (val_rates or train_rates)["f1"]
            is_best = f1 > run.best_f1
            if is_best:
                run.best, run.best_epoch, run.best_f1 = run.grader(), epoch, f1
            if on_epoch:
                on_epoch(name, epoch, run.grader(), run.optimiser, is_best, f1)
    spark = prepared.train.sparkSession
    return TrainResult(
        spark.createDataFrame(history, HISTORY),
        {n: r.best for n, r in runs.items()},
        {n: r.grader() for n, r in runs.items()},
        {n: r.best_epoch for n, r in runs.items()},
        {n: r.best_f1 for n, r in runs.items()},
        {n: r.optimiser for n, r in runs.items()},
    )


def train_grader(prepared: Prepared, initial: gm.Params | None = None, on_epoch=None) -> TrainResult:
    return train_graders(prepared, {"run": prepared.config}, initial, on_epoch)


#: what each run of the sweep changes
SWEEP = {
    "base": {},
    "fast": {"learning_rate": 1e-2},
    "slow": {"learning_rate": 1e-4},
    "no_decay": {"weight_decay": 0.0},
    "strong_decay": {"weight_decay": 0.1},
    "short_steps": {"accumulation_steps": 2},
    "long_steps": {"accumulation_steps": 8},
}


def sweep_configs(base: TrainConfig) -> dict[str, TrainConfig]:
    return {name: replace(base, **change) for name, change in SWEEP.items()}
