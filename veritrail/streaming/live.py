"""Continuous results, live search state, live scoring and a running summary."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veritrail.operators.grade import Grader, score
from veritrail.operators.guided import stop_reason
from veritrail.session import ship_package
from veritrail.sources.results import result_summary

CANDIDATE = "problem_id long, iter int, cand_idx long, chunk string, score double, eos boolean, k int"
STEP = (
    "problem_id long, iter int, final_answer string, final_score double, stopped boolean, stop_reason string"
)
#: a state is that of neighbouring problems, this many (a power of 2) at most: a call of the state function costs far more than a row
STATE, STATE_BITS = "problems string", 6


def stream_table(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """Stream one table of a folder of Parquet tables, be it one file or a folder of part files."""
    # a glob may match either; a stream takes a plain path for a folder
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def append_stream(results: DataFrame, path: str, checkpoint: str, fmt: str = "json", **trigger) -> StreamingQuery:
    """Append rows exactly once; a restart with the same checkpoint resumes."""
    return (
        results.writeStream.format(fmt).outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def score_stream(vectors: DataFrame, grader: Grader, vec: str = "vec") -> DataFrame:
    """Score arriving vectors with a saved grader."""
    return score(vectors, grader, vec)


def summary_stream(results: DataFrame, path: str, checkpoint: str, config: dict | None = None) -> StreamingQuery:
    """Keep the current count and mean final score in a one-row table."""

    def store(batch: DataFrame, _: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(path)

    return (
        result_summary(results, config).writeStream.outputMode("complete").foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Best candidate, end flag and count per iteration seen in an Arrow batch."""
    for pdf in batches:
        if pdf.empty:
            continue
        ordered = pdf.sort_values(["problem_id", "iter", "score", "cand_idx"], ascending=[True, True, False, True])
        grouped = ordered.groupby(["problem_id", "iter"], sort=False)
        top = grouped.head(1).set_index(["problem_id", "iter"])
        top["eos"] = grouped["eos"].any()
        top["n"] = grouped.size()
        yield top.reset_index()


def guided_stream(candidates: DataFrame, threshold: float = 0.95, max_iters: int = 30) -> DataFrame:
    """Live greedy search: one output row per closed iteration of a problem.

    ``candidates`` rows say how many candidates ``k`` their iteration has; it
    closes once all have come, in any order and over any number of batches.
    Candidates of closed iterations or stopped problems are late and dropped.
    Candidates combine before the shuffle, so a problem sends at most
    ``max_iters`` rows per Arrow batch. Neighbouring problem ids share a state,
    which is read and written only when rows of one of them come.
    """
    ship_package(candidates.sparkSession)
    partial = candidates.where(F.col("iter") < max_iters).mapInPandas(_combine, CANDIDATE + ", n long")
    schema = "problem_id long, iter int, answer string, chunk string, score double, eos boolean"

    def advance(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # by problem: next iteration, answer so far, open iterations; a stopped one keeps only what it takes to drop late rows
        problems = json.loads(state.get[0]) if state.exists else {}
        touched = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                next_iter, _, pending = mine = problems.setdefault(str(r.problem_id), [0, "", {}])
                if pending is None or r.iter < next_iter:
                    continue
                touched[int(r.problem_id)] = mine
                seen = pending.setdefault(str(r.iter), {"n": 0, "best": None, "eos": False})
                best = [-float(r.score), int(r.cand_idx), r.chunk]
                seen["best"] = best if seen["best"] is None else min(seen["best"], best)
                seen["eos"] = seen["eos"] or bool(r.eos)
                seen["n"] += int(r.n)
                seen["k"] = int(r.k)
        closed = []
        for problem, mine in touched.items():
            next_iter, answer, pending = mine
            stopped = False
            while not stopped and (done := pending.get(str(next_iter))) and done["n"] >= done["k"]:
                del pending[str(next_iter)]
                low, _, chunk = done["best"]
                answer += chunk
                closed.append((problem, next_iter, answer, chunk, -low, done["eos"]))
                next_iter += 1
                stopped = -low > threshold or done["eos"] or not chunk.strip() or next_iter >= max_iters
            mine[:] = [next_iter, "", None] if stopped else [next_iter, answer, pending]
        state.update((json.dumps(problems),))
        if closed:
            yield pd.DataFrame(closed, columns=["problem_id", "iter", "answer", "chunk", "score", "eos"])

    neighbours = partial.withColumn("neighbours", F.shiftright("problem_id", STATE_BITS)).groupBy("neighbours")
    steps = neighbours.applyInPandasWithState(
        advance, schema, STATE, "append", GroupStateTimeout.NoTimeout
    )
    reason = F.coalesce(
        stop_reason(threshold=threshold, eos="eos"), F.when(F.col("iter") == max_iters - 1, F.lit("max_iters"))
    )
    return steps.select(
        "problem_id", "iter", F.col("answer").alias("final_answer"), F.col("score").alias("final_score"),
        reason.isNotNull().alias("stopped"), reason.alias("stop_reason"),
    )


def latest_steps(steps: DataFrame) -> DataFrame:
    """Current state per problem from the appended steps."""
    last = F.max_by(F.struct("iter", "final_answer", "final_score", "stopped", "stop_reason"), "iter")
    return steps.groupBy("problem_id").agg(last.alias("_s")).select("problem_id", "_s.*")
