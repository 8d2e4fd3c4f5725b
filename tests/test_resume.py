"""Searches that are broken off and gone on with, against unbroken ones."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from test_searches import grade_by, greedy
from veritrail.operators import guided
from veritrail.plans import queries
from veritrail.plans.tables import sentence_pool
from veritrail.sources.results import RoundLog

POOL = ["a ", "bb ", "c c ", "", "dd ", "e ", " "]
SETTINGS = {"k": 2}


class Broken(Exception):
    pass


@pytest.fixture(scope="module")
def generate(spark):
    return guided.pool_generator(spark.createDataFrame(list(enumerate(POOL)), "pool_idx long, chunk string"), len(POOL))


def problems_of(spark, ids):
    return spark.createDataFrame([(i, f"p{i}") for i in ids], "problem_id long, problem string")


def failing_in(generate, number):
    def run(rows):
        if rows.where(F.col("round") == number).count():
            raise Broken
        return generate(rows)

    return run


def run(spark, path, ids, generate):
    log = RoundLog(spark, str(path), SETTINGS)
    rows = guided.search(problems_of(spark, ids), generate, grade_by("problem_id", "cand_idx"), 2, 0.97, 5, rounds=log)
    return {r.problem_id: (r.final_answer, r.final_score, r.last_iter, r.stop_reason) for r in rows.collect()}, log


def published(log):
    return Counter((r.problem_idx, r.final_answer) for r in log.results().collect())


def test_a_search_broken_in_its_third_round_goes_on(spark, tmp_path, generate):
    want = {i: greedy(i, f"p{i}", 2, 0.97, 5, "any") for i in range(40)}
    assert max(w[2] for w in want.values()) >= 3
    with pytest.raises(Broken):
        run(spark, tmp_path, range(40), failing_in(generate, 2))
    log = RoundLog(spark, str(tmp_path))
    assert log.numbers() == [0, 1]
    # what two rounds finished is there already
    assert set(published(log)) == {(i, w[0]) for i, w in want.items() if w[2] < 2}
    drawn = []

    def watched(rows):
        drawn.extend(r["round"] for r in rows.select("round").distinct().collect())
        return generate(rows)

    got, log = run(spark, tmp_path, range(40), watched)
    assert got == want and min(drawn) == 2
    assert published(log) == Counter((i, w[0]) for i, w in want.items())


def test_results_that_a_crash_left_unpublished_come_once(spark, tmp_path, generate, monkeypatch):
    publish = RoundLog._publish

    def crash(self, number):
        if number == 1:
            raise Broken
        publish(self, number)

    monkeypatch.setattr(RoundLog, "_publish", crash)
    with pytest.raises(Broken):
        run(spark, tmp_path, range(12), generate)
    monkeypatch.undo()
    want = {i: greedy(i, f"p{i}", 2, 0.97, 5, "any") for i in range(12)}
    for _ in range(2):  # the second time nothing is left to do
        got, log = run(spark, tmp_path, range(12), generate)
        assert got == want and published(log) == Counter((i, w[0]) for i, w in want.items())


def test_a_half_written_round_does_not_count(spark, tmp_path, generate):
    with pytest.raises(Broken):
        run(spark, tmp_path, range(12), failing_in(generate, 1))
    spark.range(3).write.parquet(f"{tmp_path}/_drafts/lost")
    got, log = run(spark, tmp_path, range(12), generate)
    assert got == {i: greedy(i, f"p{i}", 2, 0.97, 5, "any") for i in range(12)}
    with pytest.raises(FileExistsError):
        log.commit(0, log.read(0))


def test_new_problems_join_a_finished_search(spark, tmp_path, generate):
    run(spark, tmp_path, range(6), generate)
    got, log = run(spark, tmp_path, range(9), generate)
    assert got == {i: greedy(i, f"p{i}", 2, 0.97, 5, "any") for i in range(9)}
    assert sum(published(log).values()) == 9


def test_other_settings_and_no_problems(spark, tmp_path, generate):
    got, log = run(spark, tmp_path / "none", [], generate)
    assert got == {} and log.numbers() == [0] and published(log) == {}
    with pytest.raises(ValueError, match="was begun with"):
        RoundLog(spark, str(tmp_path / "none"), {"k": 3})


def test_max_new_bounds_a_chunk(spark):
    pool = spark.createDataFrame([(0, "one two  three four five ")], "pool_idx long, chunk string")
    one = problems_of(spark, [1]).withColumns({"round": F.lit(0), "text": F.lit("")})
    cut = {n: guided.pool_generator(pool, 1)(guided.fan_out(one, 2, n)).first().chunk for n in (1, 3, 50)}
    assert cut == {1: "one", 3: "one two ", 50: "one two  three four five "}
    seen = []

    def watch(rows):
        seen.append([r.max_new for r in rows.collect()])
        return guided.pool_generator(pool, 1)(rows)

    found = guided.search(problems_of(spark, [1]), watch, grade_by("problem_id", "cand_idx"), 2, 2.0, 1, max_new=3)
    assert found.first().final_answer == "one two " and seen == [[3, 3]]


def test_chunks_of_a_live_search_are_whole_without_a_bound(spark, sf_dir):
    words = [f"w{i}" for i in range(120)]
    pool = spark.createDataFrame([(0, " ".join(words))], "pool_idx long, chunk string")
    found = guided.search(problems_of(spark, [1]), guided.pool_generator(pool, 1), grade_by("problem_id", "cand_idx"), 2, 2.0, 1, max_new=None)
    assert found.first().final_answer == " ".join(words)
    log = []
    queries.guided_rounds(spark, sf_dir, log).count()
    drawn = {r.chunk for rows in log for r in rows.select("chunk").collect()}
    assert drawn <= {r.chunk for r in sentence_pool(spark, sf_dir).select("chunk").collect()}
    assert max(len(c.split(" ")) for c in drawn) > 50
