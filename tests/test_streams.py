import json
import random

import pytest

from veritrail.operators import guided
from veritrail.plans import queries
from veritrail.plans.queries import dense_log
from veritrail.streaming import live


def run_guided(spark, folder, tmp_path, per_trigger=1, **limits):
    source = spark.readStream.schema(live.CANDIDATE).option("maxFilesPerTrigger", per_trigger).json(str(folder))
    live.append_stream(live.guided_stream(source, **limits), f"{tmp_path}/out", f"{tmp_path}/cp", "parquet").awaitTermination()
    return live.latest_steps(spark.read.schema(live.STEP).parquet(f"{tmp_path}/out"))


def lay(folder, name, rows):
    folder.mkdir(exist_ok=True)
    keys = ["problem_id", "iter", "cand_idx", "chunk", "score", "eos", "k"]
    (folder / name).write_text("".join(json.dumps(dict(zip(keys, r))) + "\n" for r in rows))


def test_stream_equals_replay_whatever_the_arrival(spark, sf_dir, tmp_path):
    log = dense_log(spark, sf_dir)
    want = {r.problem_id: (r.final_answer, r.final_score, r.last_iter) for r in guided.replay(log).collect()}
    rows = [tuple(r) for r in log.collect()]
    random.Random(5).shuffle(rows)
    for i in range(3):
        lay(tmp_path / "in", f"{i}.json", rows[i::3])
    got = {r.problem_id: (r.final_answer, r.final_score, r.iter) for r in run_guided(spark, tmp_path / "in", tmp_path).collect()}
    assert got == want


def test_groups_straddle_batches_and_late_rows_are_dropped(spark, tmp_path):
    folder = tmp_path / "in"
    lay(folder, "0.json", [(1, 0, 0, "x", 0.5, False, 2)])
    assert run_guided(spark, folder, tmp_path).count() == 0
    lay(folder, "1.json", [(1, 0, 1, "y", 0.5, False, 2), (1, 1, 0, "z", 0.99, False, 1)])
    r = run_guided(spark, folder, tmp_path).first()
    # a tie goes to the first candidate; the threshold then stops the problem
    assert (r.final_answer, r.final_score, r.stopped, r.stop_reason) == ("xz", 0.99, True, "threshold")
    lay(folder, "2.json", [(1, 0, 2, "late", 1.0, False, 2), (1, 2, 0, "after", 1.0, False, 1)])
    assert run_guided(spark, folder, tmp_path).first().final_answer == "xz"


def test_append_resumes_where_it_stopped(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "problem_idx long, problem string, final_answer string, final_score double"

    def step(i):
        (folder / f"{i}.json").write_text(json.dumps({"problem_idx": i, "problem": "p", "final_answer": "é", "final_score": i / 4}) + "\n")
        arriving = spark.readStream.schema(schema).json(str(folder))
        live.append_stream(arriving, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        live.summary_stream(arriving, f"{tmp_path}/sum", f"{tmp_path}/cps", {"k": 5}).awaitTermination()

    step(1)
    step(2)
    assert sorted(r.problem_idx for r in spark.read.schema(schema).json(f"{tmp_path}/out").collect()) == [1, 2]
    row = spark.read.parquet(f"{tmp_path}/sum").first()
    assert (row.num_problems, row.avg_final_score, row.config) == (2, 0.375, {"k": "5"})


@pytest.mark.parametrize("max_iters", [1, 2])
def test_stream_obeys_max_iters(spark, tmp_path, max_iters):
    lay(tmp_path / "in", "0.json", [(1, i, 0, f"c{i}", 0.1, False, 1) for i in range(4)])
    r = run_guided(spark, tmp_path / "in", tmp_path, max_iters=max_iters).first()
    assert (r.final_answer, r.stop_reason) == ("".join(f"c{i}" for i in range(max_iters)), "max_iters")


def test_streamed_tables_may_be_folders_of_part_files(spark, sf_dir, tmp_path):
    for name in ("embeddings", "events"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for query in (queries.stream_score, queries.stream_append, queries.stream_summary):
        want = sorted(map(tuple, query(spark, sf_dir).collect()))
        assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == want and want


def test_neighbouring_problems_share_a_state(spark, tmp_path):
    folder, ids = tmp_path / "in", range(-100, 100)
    for cand in range(2):
        lay(folder, f"{cand}.json", [(i, 0, cand, f"{i}:{cand}", 0.5 + cand / 10, False, 2) for i in ids])
    source = spark.readStream.schema(live.CANDIDATE).option("maxFilesPerTrigger", 1).json(str(folder))
    query = live.append_stream(live.guided_stream(source), f"{tmp_path}/out", f"{tmp_path}/cp", "parquet")
    query.awaitTermination()
    got = {r.problem_id: r.final_answer for r in spark.read.schema(live.STEP).parquet(f"{tmp_path}/out").collect()}
    assert got == {i: f"{i}:1" for i in ids}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= len(ids) / 2**live.STATE_BITS + 2


def test_a_longer_log_comes_in_no_more_batches(spark, sf_dir, monkeypatch):
    want, started, append, log = sorted(map(tuple, queries.stream_guided(spark, sf_dir).collect())), [], live.append_stream, dense_log
    monkeypatch.setattr(queries, "dense_log", lambda *given: log(*given).repartition(40))
    monkeypatch.setattr(live, "append_stream", lambda *given: started.append(append(*given)) or started[0])
    assert sorted(map(tuple, queries.stream_guided(spark, sf_dir).collect())) == want
    assert len([p for p in started[0].recentProgress if p["numInputRows"]]) <= 8
