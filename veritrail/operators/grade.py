"""Scoring tables of vectors with a grader."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions import grader_math as gm
from veritrail.functions.chat import chat_messages, render_chat, system_prompt
from veritrail.functions.vectors import affine, as_double, sigmoid
from veritrail.operators.encode import States
from veritrail.session import ship_package

GradeTexts = Callable[[DataFrame], DataFrame]


@dataclass
class Grader:
    """A shape, its weights and, with batch normalisation, running statistics."""

    spec: gm.GraderSpec
    params: gm.Params
    running: gm.Params = field(default_factory=dict)


def linear_grader(weights, bias: float = 0.0) -> Grader:
    """A grader with no hidden layer."""
    w = np.asarray(weights, dtype=np.float64)
    spec = gm.GraderSpec(in_dim=len(w), hidden_dims=(), dropout=0.0)
    return Grader(spec, {"out.w": w[None, :], "out.b": np.array([float(bias)])})


def logit_column(df: DataFrame, grader: Grader, vec: str | Column) -> Column:
    """Logit of a vector column.

    Without a hidden layer this is a JVM expression. Otherwise only the vector
    column crosses to Python, in Arrow batches, with the weights broadcast.
    """
    c = F.col(vec) if isinstance(vec, str) else vec
    if not grader.spec.residual and not grader.spec.hidden_dims:
        return affine(as_double(c), grader.params["out.w"], grader.params["out.b"])[0]
    ship_package(df.sparkSession)
    # plain arrays in the broadcast, the shape in the closure
    shared = df.sparkSession.sparkContext.broadcast((grader.params, grader.running))
    spec = grader.spec

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        params, running = shared.value
        for batch in batches:
            if len(batch) == 0:
                yield pd.Series([], dtype="float64")
                continue
            x = np.stack(batch.to_numpy())
            yield pd.Series(gm.logits(spec, params, x, running))

    # evaluated once per row, even where a filter on its result is pushed down
    return run.asNondeterministic()(c)


def score(df: DataFrame, grader: Grader, vec: str = "vec") -> DataFrame:
    """Add ``logit`` and ``prob``; the loss of a labelled table is an aggregate."""
    scored = df.withColumn("logit", logit_column(df, grader, vec))
    return scored.withColumn("prob", sigmoid(F.col("logit")))


def chat_grader(
    keys: list[str], tokenise: Callable[[Column], Column], states: States, grader: Grader,
    profile: str = "search", mode: str = "continue",
) -> GradeTexts:
    """Plug-in for the searches: grade partial answers by their last state.

    The returned function takes rows with ``keys``, ``problem`` and ``text``,
    renders each as a chat whose answer is left open, and gives
    ``(keys, score)``, rounded so that summation order cannot move a threshold.
    """

    def grade(df: DataFrame) -> DataFrame:
        messages = chat_messages(system_prompt(profile), F.col("problem"), F.col("text"))
        encoded = df.select(*keys, tokenise(render_chat(messages, mode)).alias("_ids"))
        return score(states.final(encoded, keys, "_ids"), grader).select(*keys, F.round("prob", 6).alias("score"))

    return grade
