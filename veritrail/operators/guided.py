"""Greedy best-of-k search over a table of problems, live or from a log."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.text import is_blank
from veritrail.operators.grade import GradeTexts
from veritrail.operators.skew import lookup_join, measured_bytes
from veritrail.session import cut_lineage, ship_package
from veritrail.sources.results import RoundLog

# A generator takes fan-out rows (problem_id, problem, round, text, max_new,
# cand_idx) and adds ``chunk`` and ``eos``, for the tree search ``logprob`` too.
# ``text`` is the answer so far, ``max_new`` the most tokens of the chunk, null for no bound.
Generator = Callable[[DataFrame], DataFrame]


def model_generator(
    generate: Callable[[pd.DataFrame], pd.DataFrame], extra: str = "chunk string, eos boolean, logprob double"
) -> Generator:
    """Wrap a batch function of a language model; it adds the ``extra`` columns."""

    def run(df: DataFrame) -> DataFrame:
        def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                yield generate(pdf)

        ship_package(df.sparkSession)
        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.mapInPandas(batches, f"{kept}, {extra}")

    return run


def pool_generator(pool: DataFrame, size: int, seed: str = "pool", eos_every: int = 7) -> Generator:
    """Stand-in generator: chunks drawn from a numbered pool ``(pool_idx, chunk)``.

    The draw is an md5 of seed, problem, round and candidate, so every retry and
    every partitioning draws the same chunk. Its tokens are what single spaces
    part; the first ``max_new`` of them are kept, all where it is null.
    """

    pool_bytes = measured_bytes(pool)

    def run(df: DataFrame) -> DataFrame:
        draw = F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in ("problem_id", "round", "cand_idx")]))
        number = F.conv(F.substring(draw, 1, 8), 16, 10).cast("long")
        other = F.conv(F.substring(draw, 9, 8), 16, 10).cast("long")
        drawn = df.withColumns(
            {
                "pool_idx": F.pmod(number, F.lit(size)).cast("long"),
                "eos": F.pmod(other, F.lit(eos_every)) == 0,
                "logprob": -F.pmod(other, F.lit(1000)) / F.lit(250.0),
            }
        )
        met = lookup_join(drawn, pool, ["pool_idx"], measured=pool_bytes).drop("pool_idx")
        bounded = F.array_join(F.slice(F.split("chunk", " ", -1), F.lit(1), F.col("max_new")), " ")
        return met.withColumn("chunk", F.when(F.col("max_new").isNull(), F.col("chunk")).otherwise(bounded))

    return run


def fan_out(problems: DataFrame, k: int, max_new: int | None) -> DataFrame:
    """k numbered copies of each active problem, which may grow by ``max_new`` tokens, or by any number without it."""
    return problems.select("*", F.lit(max_new).cast("int").alias("max_new"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("cand_idx"))


def best_candidates(
    candidates: DataFrame, keys: Sequence[str], carry: Sequence[str], order: str = "cand_idx", score: str = "score"
) -> DataFrame:
    """Highest score per group, the first candidate winning ties.

    A plain aggregate, so groups of any size combine before the shuffle. Also
    gives whether any candidate of the group ended.
    """
    first = F.struct(F.col(score), -F.col(order))
    picked = F.max_by(F.struct(order, score, "eos", *carry), first)
    grouped = candidates.groupBy(*keys).agg(picked.alias("_best"), F.bool_or("eos").alias("any_eos"))
    return grouped.select(*keys, "any_eos", *[F.col("_best")[c].alias(c) for c in (order, score, "eos", *carry)])


def stop_reason(
    score: str = "score", chunk: str = "chunk", threshold: float = 0.95, eos: str = "any_eos"
) -> Column:
    """First stop rule that applies, or null to go on.

    ``eos`` names the flag that ends the search: that of any candidate for the
    greedy search, that of the chosen one for the tree search.
    """
    return (
        F.when(F.col(score) > F.lit(threshold), F.lit("threshold"))
        .when(F.col(eos), F.lit("eos"))
        .when(is_blank(chunk), F.lit("blank"))
    )


def replay(
    log: DataFrame,
    threshold: float = 0.95,
    max_iters: int = 30,
    order: str = "cand_idx",
    eos_scope: str = "any",
) -> DataFrame:
    """Outcome per problem from logged candidates, with no loop and no generator.

    ``log`` has ``problem_id, iter, <order>, chunk, score, eos``, iterations
    counted from 0. Winners are picked per iteration, then at most ``max_iters``
    of them meet per problem.
    """
    best = best_candidates(log.where(F.col("iter") < max_iters), ["problem_id", "iter"], ["chunk"], order)
    judged = best.withColumn("reason", stop_reason(threshold=threshold, eos="any_eos" if eos_scope == "any" else "eos"))
    steps = judged.groupBy("problem_id").agg(
        # bounded by max_iters entries
        F.array_sort(F.collect_list(F.struct("iter", "chunk", "score", "reason"))).alias("_steps")
    )
    stop_at = F.array_min(F.transform(F.filter("_steps", lambda s: s["reason"].isNotNull()), lambda s: s["iter"]))
    walked = steps.withColumn("_stop", stop_at).withColumn(
        "_walk", F.filter("_steps", lambda s: F.col("_stop").isNull() | (s["iter"] <= F.col("_stop")))
    )
    last = F.element_at("_walk", -1)
    return walked.select(
        "problem_id",
        F.array_join(F.transform("_walk", lambda s: s["chunk"]), "").alias("final_answer"),
        last["score"].alias("final_score"),
        last["iter"].alias("last_iter"),
        F.size("_walk").alias("n_rounds"),
        F.coalesce(last["reason"], F.lit("max_iters")).alias("stop_reason"),
    )


def search(
    problems: DataFrame,
    generate: Generator,
    grade: GradeTexts,
    k: int = 5,
    threshold: float = 0.95,
    max_iters: int = 10,
    log: list[DataFrame] | None = None,
    eos_scope: str = "any",
    max_new: int | None = 50,
    rounds: RoundLog | None = None,
) -> DataFrame:
    """Guided generation for all problems at once, one job per round.

    ``problems`` is ``(problem_id, problem)``. ``grade`` scores rows keyed by
    ``problem_id, cand_idx`` with ``problem`` and ``text``. Problems that stop
    leave the active set. Each round's candidates are appended to ``log``.

    With ``rounds`` every round is committed to a folder before the next one
    begins, and a search over the same folder goes on behind its last committed
    round: finished problems are not touched, open ones go on from their stored
    texts and iterations, problems that no round has seen start. Problem ids
    are then unique.
    """
    if max_iters < 1:
        raise ValueError("max_iters must be at least 1")
    known = ["problem_id", "problem"]
    active = problems.select(*known, F.lit("").alias("text"), F.lit(0).alias("iter"))
    number = 0
    if rounds is not None and rounds.numbers():
        number = rounds.numbers()[-1] + 1
        seen = rounds.read().select("problem_id").distinct()
        going = rounds.read(number - 1).where(F.col("reason").isNull())
        active = active.join(seen, "problem_id", "left_anti").unionByName(
            going.select(*known, "text", (F.col("iter") + 1).alias("iter"))
        )
    active = cut_lineage(active)
    held: list[DataFrame] = []
    # the first round runs over an empty table too, so that there is a result to read
    while (number == 0 and not held) or not active.isEmpty():
        wide = generate(fan_out(active.withColumn("round", F.col("iter")), k, max_new))
        # sampling need not repeat itself, so what was drawn is kept
        answers = cut_lineage(wide.withColumn("answer", F.concat("text", "chunk")))
        scores = grade(answers.select("problem_id", "cand_idx", "problem", F.col("answer").alias("text")))
        graded = answers.join(scores, ["problem_id", "cand_idx"])
        if log is not None:
            log.append(graded.select("problem_id", "iter", "cand_idx", "chunk", "score", "eos"))
        flag = "any_eos" if eos_scope == "any" else "eos"
        best = best_candidates(graded, [*known, "iter"], ["chunk", "answer"])
        last = F.when(F.col("iter") >= max_iters - 1, F.lit("max_iters"))
        judged = best.select(
            *known, F.col("answer").alias("text"), "score", "iter",
            F.coalesce(stop_reason(threshold=threshold, eos=flag), last).alias("reason"),
        )
        judged = cut_lineage(judged) if rounds is None else rounds.commit(number, judged)
        held.append(judged)
        active = judged.where(F.col("reason").isNull()).select(*known, "text", (F.col("iter") + 1).alias("iter"))
        number += 1
    all_rounds = reduce(DataFrame.unionByName, held) if rounds is None else rounds.read()
    return all_rounds.where(F.col("reason").isNotNull()).select(
        *known, F.col("text").alias("final_answer"), F.col("score").alias("final_score"),
        F.col("iter").alias("last_iter"), F.col("reason").alias("stop_reason"),
    )
