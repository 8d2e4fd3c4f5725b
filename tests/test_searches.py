"""Both searches against plain loops over the same draws and grades."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from veritrail.functions import search as fs
from veritrail.operators import guided, tree

POOL = ["a ", "bb ", "c c ", "", "dd ", "e ", " "]


def digest(text):
    return hashlib.md5(text.encode()).hexdigest()


def draw(problem, round_, cand):
    d = digest(f"pool:{problem}:{round_}:{cand}")
    other = int(d[8:16], 16)
    return POOL[int(d[:8], 16) % len(POOL)], other % 7 == 0, -(other % 1000) / 250.0


def mark(problem, text):
    return int(digest(f"{problem}|{text}")[:8], 16) % 997 / 1000.0


def grade_by(*keys):
    number = F.conv(F.substring(F.md5(F.concat_ws("|", "problem", "text")), 1, 8), 16, 10).cast("long")
    return lambda df: df.select(*keys, (F.pmod(number, F.lit(997)) / 1000.0).alias("score"))


@pytest.fixture(scope="module")
def generate(spark):
    pool = spark.createDataFrame(list(enumerate(POOL)), "pool_idx long, chunk string")
    return guided.pool_generator(pool, len(POOL))


@pytest.fixture(scope="module")
def problems(spark):
    return spark.createDataFrame([(i, f"p{i}") for i in range(12)], "problem_id long, problem string")


def greedy(problem_id, problem, k, threshold, max_iters, scope):
    text = ""
    for it in range(max_iters):
        drawn = [draw(problem_id, it, c) for c in range(k)]
        scores = [mark(problem, text + chunk) for chunk, _, _ in drawn]
        best = scores.index(max(scores))
        chunk, eos, _ = drawn[best]
        text += chunk
        if scores[best] > threshold:
            return text, scores[best], it, "threshold"
        if any(e for _, e, _ in drawn) if scope == "any" else eos:
            return text, scores[best], it, "eos"
        if not chunk.strip():
            return text, scores[best], it, "blank"
    return text, scores[best], it, "max_iters"


@pytest.mark.parametrize("k,threshold,max_iters,scope", [(3, 0.9, 5, "any"), (2, 0.97, 4, "chosen"), (1, 0.5, 1, "any")])
def test_guided_search_equals_loop_and_its_own_replay(spark, problems, generate, k, threshold, max_iters, scope):
    log = []
    found = guided.search(problems, generate, grade_by("problem_id", "cand_idx"), k, threshold, max_iters, log, scope)
    got = {r.problem_id: (r.final_answer, r.final_score, r.last_iter, r.stop_reason) for r in found.collect()}
    assert got == {i: greedy(i, f"p{i}", k, threshold, max_iters, scope) for i in range(12)}
    logged = log[0]
    for part in log[1:]:
        logged = logged.unionByName(part)
    again = guided.replay(logged, threshold, max_iters, eos_scope=scope)
    assert got == {r.problem_id: (r.final_answer, r.final_score, r.last_iter, r.stop_reason) for r in again.collect()}


def candidates(spark, rows):
    return spark.createDataFrame(rows, "problem_id long, iter int, cand_idx int, chunk string, score double, eos boolean")


def test_first_candidate_wins_ties(spark):
    df = candidates(spark, [(1, 0, 2, "z", 0.5, False), (1, 0, 1, "y", 0.5, False), (1, 0, 0, "x", 0.4, True)])
    r = guided.best_candidates(df, ["problem_id", "iter"], ["chunk"]).first()
    assert (r.cand_idx, r.chunk, r.eos, r.any_eos) == (1, "y", False, True)


def test_stop_rules(spark):
    # an end token on a losing candidate stops the search and keeps the winner
    losing = candidates(spark, [(1, 0, 0, "w", 0.6, False), (1, 0, 1, "l", 0.1, True), (1, 1, 0, "n", 0.7, False)])
    r = guided.replay(losing).first()
    assert (r.final_answer, r.stop_reason, r.n_rounds) == ("w", "eos", 1)
    assert guided.replay(losing, eos_scope="chosen").first().final_answer == "wn"
    # a score equal to the threshold goes on
    equal = candidates(spark, [(1, 0, 0, "a", 0.95, False), (1, 1, 0, "b", 0.951, False), (1, 2, 0, "c", 1.0, False)])
    r = guided.replay(equal).first()
    assert (r.final_answer, r.stop_reason, r.last_iter) == ("ab", "threshold", 1)
    blank = candidates(spark, [(1, 0, 0, "a", 0.1, False), (1, 1, 0, " \n", 0.2, False), (1, 2, 0, "c", 0.3, False)])
    assert guided.replay(blank).first().stop_reason == "blank"
    assert guided.replay(equal, threshold=2.0, max_iters=2).first().final_answer == "ab"
    assert guided.replay(equal.limit(0)).count() == 0


def test_bad_limits_are_refused(problems, generate):
    with pytest.raises(ValueError):
        guided.search(problems, generate, grade_by("problem_id", "cand_idx"), max_iters=0)
    with pytest.raises(ValueError):
        tree.search(problems, generate, grade_by("problem_id"), max_iters=0)


class Node:
    def __init__(self, text, depth, prior, eos, ident):
        self.text, self.depth, self.prior, self.eos, self.ident = text, depth, prior, eos, ident
        self.kids, self.visits, self.total, self.shut = [], 0, 0.0, False


def tree_by_hand(problem_id, problem, k_root, k, threshold, max_iters, sims, c, max_depth):
    def expand(node, round_, width, count):
        drawn = [draw(problem_id, round_, i) for i in range(width)]
        top = max(lp for *_, lp in drawn)
        total = sum(math.exp(lp - top) for *_, lp in drawn)
        for chunk, eos, lp in drawn:
            node.kids.append((chunk, Node(node.text + chunk, node.depth + 1, math.exp(lp - top) / total, eos, count[0])))
            count[0] += 1

    text, trees = "", []
    for it in range(max_iters):
        root, count = Node(text, 0, 1.0, False, 0), [1]
        expand(root, f"{it}.root", k_root, count)
        for _ in range(sims):
            node, path = root, [root]
            while node.kids and not node.shut and not node.eos:
                def value(kid):
                    q = kid.total / kid.visits if kid.visits else 0.0
                    return q + c * kid.prior * math.sqrt(max(1, node.visits)) / (1 + kid.visits)

                node = max((kid for _, kid in node.kids), key=value)
                path.append(node)
                if node.depth >= max_depth:
                    break
            score = mark(problem, node.text)
            if node.depth >= max_depth or node.eos:
                node.shut = True
            elif not node.kids:
                expand(node, f"{it}.{node.ident}", k, count)
            for n in path:
                n.visits += 1
                n.total += score
        trees.append((root.visits, count[0]))
        chunk, best = max(root.kids, key=lambda kid: kid[1].visits)
        text, score = best.text, mark(problem, best.text)
        if score > threshold:
            return text, score, it, "threshold", trees
        if best.eos:
            return text, score, it, "eos", trees
        if not chunk.strip():
            return text, score, it, "blank", trees
    return text, score, it, "max_iters", trees


@pytest.mark.parametrize("k_root,k,sims,depth,c", [(3, 2, 6, 3, 1.0), (2, 3, 3, 1, 0.3), (3, 3, 0, 2, 1.0)])
def test_tree_search_equals_loop(spark, problems, generate, k_root, k, sims, depth, c):
    trees = []
    found = tree.search(problems, generate, grade_by("problem_id"), k_root, k, 0.9, 2, sims, c, depth, trees)
    got = {r.problem_id: (r.final_answer, r.final_score, r.last_iter, r.stop_reason) for r in found.collect()}
    want = {i: tree_by_hand(i, f"p{i}", k_root, k, 0.9, 2, sims, c, depth) for i in range(12)}
    assert got == {i: w[:4] for i, w in want.items()}
    for it, state in enumerate(trees):
        for r in state.collect():
            root_visits, size = want[r.problem_id][4][it]
            assert (r.nodes[0].visits, len(r.nodes)) == (root_visits, size)
            assert root_visits == sims
            kids = {}
            for n in r.nodes[1:]:
                kids.setdefault(n.parent_id, []).append(n)
            for parent, group in kids.items():
                assert sum(n.prior for n in group) == pytest.approx(1.0)
                assert r.nodes[parent].visits >= sum(n.visits for n in group)


def test_problems_without_candidates(spark, problems):
    def nothing(df):
        return df.where("false").withColumns({"chunk": F.lit(""), "eos": F.lit(False), "logprob": F.lit(0.0)})

    rows = tree.search(problems, nothing, grade_by("problem_id"), num_simulations=2, max_iters=2).collect()
    assert len(rows) == 12 and {(r.stop_reason, r.final_answer) for r in rows} == {("no_candidates", "")}
    assert all(r.final_score == mark(r.problem, "") for r in rows)


def test_model_generator(spark, problems):
    def model(pdf):
        return pdf.assign(chunk=pdf["problem"] + "!", eos=True, logprob=-1.0)

    rows = guided.search(problems, guided.model_generator(model), grade_by("problem_id", "cand_idx"), k=2, max_iters=3).collect()
    assert {r.final_answer for r in rows} == {f"p{i}!" for i in range(12)} and {r.last_iter for r in rows} == {0}


NODES = (
    "tree_id int, node_id string, parent_id string, child_ord int, depth int, prior double, eos boolean, "
    "terminal boolean, visits long, value_sum double"
)


@pytest.fixture
def small_tree(spark):
    rows = [
        (1, "r", None, 0, 0, 1.0, False, False, 0, 0.0),
        (1, "a", "r", 0, 1, 0.5, False, False, 0, 0.0),
        (1, "b", "r", 1, 1, 0.5, False, False, 0, 0.0),
        (1, "a0", "a", 0, 2, 1.0, True, False, 0, 0.0),
        (1, "a1", "a0", 0, 3, 1.0, False, False, 0, 0.0),
    ]
    return spark.createDataFrame(rows, NODES)


def test_unvisited_equal_priors_take_the_first_child(small_tree):
    chosen = {r.parent_id: r for r in tree.chosen_children(small_tree).collect()}
    # an unvisited parent counts as visited once
    assert chosen["r"].child_id == "a" and chosen["r"].puct == 0.5


def test_descent_stops_at_an_ended_node_and_backup_counts_the_path(small_tree):
    walk = tree.descend(small_tree)
    r = walk.first()
    assert (r.path, r.leaf_id, r.leaf_depth) == (["r", "a", "a0"], "a0", 2)
    marked = {n.node_id: n.terminal for n in tree.mark_terminal(small_tree, walk).collect()}
    assert marked == {"r": False, "a": False, "b": False, "a0": True, "a1": False}
    after = {n.node_id: (n.visits, n.value_sum) for n in tree.backup(small_tree, walk.withColumn("value", F.lit(0.25))).collect()}
    assert after == {"r": (1, 0.25), "a": (1, 0.25), "a0": (1, 0.25), "b": (0, 0.0), "a1": (0, 0.0)}
    assert tree.descend(small_tree, max_depth=1).first().path == ["r", "a"]


def test_root_move_takes_most_visits_then_first(small_tree):
    assert tree.root_moves(small_tree).first().node_id == "a"
    more = small_tree.withColumn("visits", F.when(F.col("node_id") == "b", 3).otherwise(F.col("visits")).cast("long"))
    assert tree.root_moves(more).first().node_id == "b"


def test_array_and_relational_forms_agree(spark, problems, generate):
    trees = []
    tree.search(problems, generate, grade_by("problem_id"), 3, 2, 2.0, 1, 5, 1.0, 3, trees).collect()
    nodes = tree.tree_rows(trees[0])
    moves = {r.tree_id: r.node_id for r in tree.root_moves(nodes).collect()}
    simulation = tree._Simulation(generate, grade_by("problem_id"), 2, 3, 1.0)
    walk = trees[0].withColumns(simulation.start)
    for _ in range(3):
        walk = walk.withColumn("_next", simulation.next).withColumns(simulation.move)
    by_array = {r.problem_id: r.path for r in walk.collect()}
    by_rows = {r.tree_id: r.path for r in tree.descend(nodes, 3).collect()}
    assert by_array == by_rows
    for r in trees[0].collect():
        kids = [n for n in r.nodes if n.parent_id == 0]
        assert moves[r.problem_id] == max(kids, key=lambda n: (n.visits, -n.child_ord)).node_id


def test_search_columns(spark):
    ids, lps = F.array(*[F.lit(i) for i in (4, 3, 5, 3)]), F.array(*[F.lit(-float(i)) for i in (1, 2, 4, 8)])
    logits = F.array(F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(2.0), F.lit(0.0)))
    row = spark.range(1).select(
        fs.sequence_logprob(ids, lps, 3).alias("stop"), fs.sequence_logprob(ids, lps, 9).alias("all"),
        fs.softmax(F.array(F.lit(-1.0), F.lit(-1.0), F.lit(-800.0))).alias("p"),
        fs.sequence_logprob_from_logits(F.array(F.lit(1), F.lit(0)), logits, 9).alias("z"),
        fs.node_value(F.lit(3.0), F.lit(0)).alias("none"), fs.node_value(F.lit(3.0), F.lit(4)).alias("v"),
    ).first()
    assert row.stop == -3.0 and row["all"] == -15.0
    assert row.p == pytest.approx([0.5, 0.5, 0.0]) and (row.none, row.v) == (0.0, 0.75)
    assert row.z == pytest.approx(1 - math.log(1 + math.e) + 2 - math.log(math.e**2 + 1))


def test_a_simulation_writes_no_more_as_the_tree_grows(spark, problems, generate, tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    tree.search(problems, generate, grade_by("problem_id"), 3, 2, 2.0, 1, 6, 1.0, 9, []).collect()
    rows = {part.name: spark.read.parquet(str(part)).count() for part in (tmp_path / "tree").iterdir()}
    # one mark for each problem, at most k nodes for each leaf, whatever stands there already
    assert [rows[f"marks-{s}"] for s in range(6)] == [12] * 6
    assert max(rows[f"nodes-{s}"] for s in range(1, 7)) <= 24 and rows["nodes-0"] == 48


def test_several_leaves_to_a_job(spark, problems, generate):
    trees = []
    found = tree.search(problems, generate, grade_by("problem_id"), 3, 2, 2.0, 1, 3, 1.0, 3, trees, leaves=2)
    assert found.count() == 12
    for r in trees[0].collect():
        assert r.nodes[0].visits == 6 and [n.node_id for n in r.nodes] == list(range(len(r.nodes)))
        # the first job has no values yet: its two lanes part, and every value is a grade of a visited text
        assert sum(n.visits > 0 for n in r.nodes[1:]) >= 1
        assert r.nodes[0].value_sum == pytest.approx(sum(n.grade * own for n, own in own_visits(r.nodes)))
    with pytest.raises(ValueError):
        tree.search(problems, generate, grade_by("problem_id"), leaves=0)


def own_visits(nodes):
    """How often each node itself was the leaf: its visits without those of its children."""
    for n in nodes:
        own = n.visits - sum(c.visits for c in nodes if c.parent_id == n.node_id)
        if own:
            yield n, own
