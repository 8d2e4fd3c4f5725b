"""PUCT tree search.

Two forms. The relational operators work on one row per node and fit trees of
any size. The search over many problems keeps an append-only log of each move's
trees: a simulation adds one row per leaf that it reached and the nodes that it
expanded, and never writes again what stands there. Descent gathers a problem's
nodes in its row, an array that the simulations and the fan-out bound, so that
the walk down is a projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.functions.search import node_value, puct, softmax
from veritrail.operators.grade import GradeTexts
from veritrail.operators.guided import Generator, fan_out, stop_reason
from veritrail.operators.skew import HOT_ROWS, attach_group_stats, hot_keys, lookup_join
from veritrail.session import cut_lineage, drop_scratch, scratch_path, written_table

# --- one row per node: tree_id, node_id, parent_id, child_ord, depth, prior,
# --- eos, terminal, visits, value_sum


def sibling_priors(
    df: DataFrame, keys: list[str], logprob: str = "logprob", out: str = "prior", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Softmax over the siblings of each group, whatever the group's size."""
    hot = hot_keys(df, keys, hot_rows)
    peaked = attach_group_stats(df, keys, {"_top": F.max(logprob)}, hot)
    raised = peaked.withColumn("_pow", F.exp(F.col(logprob) - F.col("_top")))
    summed = attach_group_stats(raised, keys, {"_sum": F.sum("_pow")}, hot)
    return summed.withColumn(out, F.col("_pow") / F.col("_sum")).drop("_top", "_pow", "_sum")


def scored_children(nodes: DataFrame, c_puct: float = 1.0) -> DataFrame:
    """Every child with its PUCT score; the parent's visits come by join."""
    parents = nodes.select("tree_id", F.col("node_id").alias("parent_id"), F.col("visits").alias("_seen"))
    children = nodes.where(F.col("parent_id").isNotNull())
    met = lookup_join(children, parents, ["tree_id", "parent_id"])
    value = node_value(F.col("value_sum"), F.col("visits"))
    return met.withColumn("puct", puct(value, F.col("prior"), F.col("_seen"), F.col("visits"), c_puct)).drop("_seen")


def chosen_children(nodes: DataFrame, c_puct: float = 1.0, digits: int | None = None) -> DataFrame:
    """Best child per parent, the first one winning ties.

    ``digits`` rounds scores before they are compared, for sums whose order
    may vary between runs.
    """
    scored = scored_children(nodes, c_puct)
    if digits is not None:
        scored = scored.withColumn("puct", F.round("puct", digits))
    pick = F.max_by(F.struct("node_id", "puct"), F.struct(F.col("puct"), -F.col("child_ord")))
    best = scored.groupBy("tree_id", "parent_id").agg(pick.alias("_b"))
    return best.select("tree_id", "parent_id", F.col("_b.node_id").alias("child_id"), F.col("_b.puct").alias("puct"))


def descend(nodes: DataFrame, max_depth: int = 3, c_puct: float = 1.0, digits: int | None = None) -> DataFrame:
    """``(tree_id, path, leaf_id, leaf_depth)`` of one selection per tree.

    The walk goes on while the node has a child and neither ended nor is
    terminal, down to ``max_depth``.
    """
    chosen = chosen_children(nodes, c_puct, digits)
    shut = nodes.where(F.col("eos") | F.col("terminal")).select("tree_id", F.col("node_id").alias("parent_id"))
    steps = chosen.join(shut, ["tree_id", "parent_id"], "left_anti").select(
        "tree_id", F.col("parent_id").alias("leaf_id"), "child_id"
    )
    walk = nodes.where(F.col("parent_id").isNull()).select(
        "tree_id", F.array("node_id").alias("path"), F.col("node_id").alias("leaf_id"),
        F.col("depth").alias("leaf_depth"),
    )
    for _ in range(max(1, max_depth)):
        met = walk.join(steps, ["tree_id", "leaf_id"], "left")
        moved = F.col("child_id").isNotNull()
        walk = met.select(
            "tree_id",
            F.when(moved, F.concat("path", F.array("child_id"))).otherwise(F.col("path")).alias("path"),
            F.coalesce("child_id", "leaf_id").alias("leaf_id"),
            F.when(moved, F.col("leaf_depth") + 1).otherwise(F.col("leaf_depth")).alias("leaf_depth"),
        )
    return walk


def mark_terminal(nodes: DataFrame, leaves: DataFrame, max_depth: int = 3) -> DataFrame:
    """Reached nodes that ended or stand at ``max_depth`` become terminal."""
    reached = leaves.select("tree_id", F.col("leaf_id").alias("node_id"), F.lit(True).alias("_reached")).distinct()
    done = F.coalesce("_reached", F.lit(False)) & ((F.col("depth") >= max_depth) | F.col("eos"))
    return (
        nodes.join(reached, ["tree_id", "node_id"], "left")
        .withColumn("terminal", F.col("terminal") | done)
        .drop("_reached")
    )


def backup(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Add one visit and the value of each ``(tree_id, path, value)`` to its nodes.

    The path rows combine to one row per node before they meet the table.
    """
    gains = (
        paths.select("tree_id", F.explode("path").alias("node_id"), "value")
        .groupBy("tree_id", "node_id")
        .agg(F.count(F.lit(1)).alias("_visits"), F.sum("value").alias("_value"))
    )
    return (
        nodes.join(gains, ["tree_id", "node_id"], "left")
        .withColumn("visits", F.col("visits") + F.coalesce("_visits", F.lit(0)))
        .withColumn("value_sum", F.col("value_sum") + F.coalesce("_value", F.lit(0.0)))
        .drop("_visits", "_value")
    )


def root_moves(nodes: DataFrame) -> DataFrame:
    """Most visited child of each root, the first one winning ties."""
    roots = nodes.where(F.col("parent_id").isNull()).select("tree_id", F.col("node_id").alias("parent_id"))
    children = nodes.join(roots, ["tree_id", "parent_id"], "left_semi")
    pick = F.max_by(F.struct("node_id", "visits", "eos"), F.struct(F.col("visits"), -F.col("child_ord")))
    best = children.groupBy("tree_id").agg(pick.alias("_b"))
    return best.select("tree_id", F.col("_b.node_id"), F.col("_b.visits"), F.col("_b.eos"))


# --- the search over many problems: a log of nodes and of simulations

NODE = (
    "struct<node_id:int,parent_id:int,child_ord:int,depth:int,prior:double,chunk:string,"
    "eos:boolean,terminal:boolean,visits:bigint,value_sum:double,grade:double>"
)
#: a node as it was born, which never changes
BORN = "struct<node_id:int,parent_id:int,child_ord:int,depth:int,prior:double,chunk:string,eos:boolean>"


def _fields(kind: str) -> list[str]:
    return [part.split(":")[0] for part in kind.removeprefix("struct<").removesuffix(">").split(",")]


class _TreeLog:
    """The trees of one move in the shared folder, as parts that are written once."""

    def __init__(self, placed: DataFrame, spark: SparkSession):
        self.placed, self.spark, self.path = placed, spark, scratch_path(spark, "tree")
        self.parts: dict[str, list[DataFrame]] = {"nodes": [], "marks": []}

    def append(self, kind: str, rows: DataFrame) -> DataFrame:
        part = written_table(rows, kind, path=f"{self.path}/{kind}-{len(self.parts[kind])}")
        self.parts[kind].append(part)
        return part

    def state(self) -> DataFrame:
        """``problem_id, problem, text, iter, nodes``: visits, values and grades of all nodes, from the marks in order."""
        nodes = reduce(DataFrame.unionByName, self.parts["nodes"])
        if self.parts["marks"]:
            marks = reduce(DataFrame.unionByName, self.parts["marks"])
            here = (F.col("node_id") == F.col("leaf")).alias("here")
            seen = marks.select("problem_id", "sim", "lane", "leaf", "value", "shut", F.explode("path").alias("node_id"))
            gains = seen.groupBy("problem_id", "node_id").agg(
                F.array_sort(F.collect_list(F.struct("sim", "lane", "value"))).alias("_gains"),
                F.bool_or(here & F.col("shut")).alias("terminal"), F.max(F.when(here, F.col("value"))).alias("grade"),
            )
            nodes = nodes.join(gains, ["problem_id", "node_id"], "left")
        else:
            nodes = nodes.withColumns({"_gains": F.lit(None).cast("array<struct<value:double>>"), "terminal": F.lit(False), "grade": F.lit(None)})
        # in the order of the simulations, so that the sum is the same in every run
        total = F.aggregate("_gains", F.lit(0.0), lambda acc, g: acc + g["value"])
        now = nodes.withColumns(
            {
                "visits": F.when(F.col("_gains").isNull(), F.lit(0)).otherwise(F.size("_gains")),
                "value_sum": F.coalesce(total, F.lit(0.0)), "terminal": F.coalesce("terminal", F.lit(False)),
            }
        )
        entry = _node(**{name: F.col(name) for name in _fields(NODE)})
        whole = now.groupBy("problem_id").agg(F.array_sort(F.collect_list(entry)).alias("nodes"))
        return self.placed.join(whole, "problem_id").select("problem_id", "problem", "text", "iter", "nodes")

    def close(self) -> None:
        drop_scratch(self.spark, self.path)


def _node(**fields: Column) -> Column:
    return F.struct(*[fields[name].alias(name) for name in _fields(NODE)]).cast(NODE)


def _born(candidates: Column, first: Column, parent: Column, depth: Column) -> Column:
    """Nodes for the sorted candidates, numbered from ``first``."""
    priors = softmax(F.transform(candidates, lambda c: c["logprob"]))
    return F.transform(
        candidates,
        lambda c, i: F.struct(
            (first + i).alias("node_id"), parent.alias("parent_id"), i.alias("child_ord"), depth.alias("depth"),
            F.get(priors, i).alias("prior"), c["chunk"].alias("chunk"), c["eos"].alias("eos"),
        ).cast(BORN),
    )


def _proposals(rows: DataFrame, generate: Generator, k: int, max_new: int) -> DataFrame:
    """``(problem_id, round, candidates)``, at most k to a round, in candidate order."""
    drawn = generate(fan_out(rows.select("problem_id", "problem", "round", "text"), k, max_new))
    entries = F.collect_list(F.struct("cand_idx", "chunk", "eos", "logprob"))
    return drawn.groupBy("problem_id", "round").agg(F.array_sort(entries).alias("candidates"))


class _Simulation:
    """One simulation in every tree: select, evaluate, expand, back up.

    The columns do not depend on the data and are built once per search.
    """

    def __init__(
        self, generate: Generator, grade: GradeTexts, k: int, max_depth: int, c_puct: float, max_new: int = 50, leaves: int = 1
    ):
        self.generate, self.grade, self.k, self.max_new, self.leaves = generate, grade, k, max_new, leaves
        self.depth_steps = max(1, max_depth)

        def rank(n: Column) -> Column:
            value = node_value(n["value_sum"], n["visits"])
            score = puct(value, n["prior"], F.col("cur.visits"), n["visits"], c_puct)
            return F.struct(score.alias("score"), (-n["child_ord"]).alias("first"), n["node_id"].alias("node_id"))

        children = F.filter("nodes", lambda n: n["parent_id"] == F.col("cur.node_id"))
        self.start = {"cur": F.get("nodes", F.lit(0)), "path": F.array(F.lit(0))}
        self.next = F.when(
            ~F.col("cur.terminal") & ~F.col("cur.eos"), F.array_max(F.transform(children, rank))["node_id"]
        )
        self.move = {
            "cur": F.coalesce(F.get("nodes", F.col("_next")), F.col("cur")),
            "path": F.when(F.col("_next").isNotNull(), F.concat("path", F.array("_next"))).otherwise(F.col("path")),
        }
        # null-safe: the root has no parent
        expanded = F.exists("nodes", lambda n: n["parent_id"].eqNullSafe(F.col("cur.node_id")))
        chunks = F.transform("path", lambda i: F.get("nodes", i)["chunk"])

        def pick(lane: int) -> Column:
            # a leaf that an earlier lane reached is expanded there
            taken = F.exists("_picks", lambda p: p["leaf"] == F.col("cur.node_id")) if lane else F.lit(False)
            return F.struct(
                F.lit(lane).alias("lane"), F.col("path"), F.col("cur.node_id").alias("leaf"), F.col("cur.depth").alias("depth"),
                F.concat("text", F.array_join(chunks, "")).alias("at"), F.col("cur.grade").alias("grade"),
                ((F.col("cur.depth") >= max_depth) | F.col("cur.eos")).alias("shut"), (expanded | taken).alias("expanded"),
            )

        self.pick = pick
        # a visit without a value, until the lane's own value is known
        self.virtual = F.transform(
            "nodes", lambda n: n.withField("visits", n["visits"] + F.array_contains("path", n["node_id"]).cast("long"))
        )

    def reached(self, state: DataFrame) -> DataFrame:
        """One row per problem and lane: the leaf, its path and its text."""
        walk = state.withColumn("_n_nodes", F.size("nodes"))
        for lane in range(self.leaves):
            walk = walk.withColumns(self.start)
            for _ in range(self.depth_steps):
                walk = walk.withColumn("_next", self.next).withColumns(self.move)
            picked = F.array(self.pick(lane))
            walk = walk.withColumn("_picks", F.concat("_picks", picked) if lane else picked)
            if lane < self.leaves - 1:
                walk = walk.withColumn("nodes", self.virtual)
        # outer: a plain explode infers a filter on the picks, which would be pushed down as one huge expression
        rows = walk.select("problem_id", "problem", "iter", "_n_nodes", F.explode_outer("_picks").alias("_p"))
        number = F.concat_ws(".", F.col("iter").cast("string"), F.col("_p.leaf").cast("string"))
        return rows.select("problem_id", "problem", "_n_nodes", "_p.*", number.alias("round"))

    def run(self, log: _TreeLog, sim: int) -> None:
        # read by the generator, the grader and the marks
        leaf = written_table(self.reached(log.state()), "leaves", path=f"{log.path}/leaves-{sim}")
        texts = leaf.withColumnRenamed("at", "text")
        fresh = _proposals(texts.where("not shut and not expanded"), self.generate, self.k, self.max_new)
        met = leaf.where("not shut and not expanded").join(fresh, ["problem_id", "round"])
        first = F.col("_n_nodes")
        if self.leaves > 1:
            # rows of this window: the leaves of one job
            earlier = Window.partitionBy("problem_id").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
            met = met.withColumn("_before", F.coalesce(F.sum(F.size("candidates")).over(earlier), F.lit(0)).cast("int"))
            first = first + F.col("_before")
        born = _born(F.col("candidates"), first, F.col("leaf"), F.col("depth") + 1)
        # written once, so the draws stand before anything is made of them
        nodes = log.append("nodes", met.select("problem_id", F.explode(born).alias("n")).select("problem_id", "n.*"))
        # a node met again keeps the grade it got: the grader is a function of the text
        asked = texts.where("grade is null").select("problem_id", "problem", "text", "lane")
        scores = reduce(
            DataFrame.unionByName,
            [self.grade(asked.where(F.col("lane") == n).drop("lane")).withColumn("lane", F.lit(n)) for n in range(self.leaves)],
        )
        parents = nodes.select("problem_id", F.col("parent_id").alias("leaf")).distinct().withColumn("_grew", F.lit(True))
        judged = leaf.join(scores, ["problem_id", "lane"], "left").join(parents, ["problem_id", "leaf"], "left")
        childless = F.col("_grew").isNull() & ~F.col("expanded")
        log.append(
            "marks",
            judged.select(
                "problem_id", F.lit(sim).alias("sim"), "lane", "path", "leaf",
                F.coalesce("grade", "score").alias("value"), (F.col("shut") | childless).alias("shut"),
            ),
        )


def search(
    problems: DataFrame,
    generate: Generator,
    grade: GradeTexts,
    k_root: int = 5,
    k: int = 5,
    threshold: float = 0.95,
    max_iters: int = 10,
    num_simulations: int = 64,
    c_puct: float = 1.0,
    max_depth: int = 3,
    trees: list[DataFrame] | None = None,
    max_new: int = 50,
    inner_max_new: int = 50,
    leaves: int = 1,
) -> DataFrame:
    """Tree-guided generation for all problems, one round of jobs per simulation.

    Each outer move starts a new tree at the text so far. ``grade`` scores rows
    keyed by ``problem_id``. The searched trees are appended to ``trees``, whose
    logs are then kept. A move grows by ``max_new`` tokens, a node below the
    root's children by ``inner_max_new``. With ``leaves`` above one a simulation
    selects that many leaves per tree before any of them is graded, each visit
    counting at once: fewer jobs for as many visits, by a slightly other walk.
    """
    if max_iters < 1:
        raise ValueError("max_iters must be at least 1")
    if leaves < 1:
        raise ValueError("leaves must be at least 1")
    simulation = _Simulation(generate, grade, k, max_depth, c_puct, inner_max_new, leaves)
    active = problems.select("problem_id", "problem", F.lit("").alias("text"))
    finished: list[DataFrame] = []
    for it in range(max_iters):
        placed = cut_lineage(active.withColumn("iter", F.lit(it)))
        roots = _proposals(placed.withColumn("round", F.lit(f"{it}.root")), generate, k_root, max_new)
        met = cut_lineage(placed.join(roots.drop("round"), "problem_id", "left"))
        stuck = met.where(F.col("candidates").isNull()).select("problem_id", "problem", "text")
        if not stuck.isEmpty():
            finished.append(_closing(stuck.join(grade(stuck), "problem_id"), it, F.lit("no_candidates")))
        log = _TreeLog(placed, placed.sparkSession)
        grown = met.where(F.col("candidates").isNotNull())
        root = F.struct(
            F.lit(0).alias("node_id"), F.lit(None).alias("parent_id"), F.lit(0).alias("child_ord"), F.lit(0).alias("depth"),
            F.lit(1.0).alias("prior"), F.lit("").alias("chunk"), F.lit(False).alias("eos"),
        ).cast(BORN)
        born = F.concat(F.array(root), _born(F.col("candidates"), F.lit(1), F.lit(0), F.lit(1)))
        log.append("nodes", grown.select("problem_id", F.explode(born).alias("n")).select("problem_id", "n.*"))
        for sim in range(num_simulations):
            simulation.run(log, sim)
        state = log.state()
        if trees is not None:
            trees.append(state)
        top = F.array_max(
            F.transform(
                F.filter("nodes", lambda n: n["parent_id"] == 0),
                lambda n: F.struct(n["visits"].alias("visits"), (-n["child_ord"]).alias("first"), n["node_id"].alias("node_id")),
            )
        )
        moved = state.withColumn("_move", F.get("nodes", top["node_id"])).select(
            "problem_id", "problem", F.concat("text", F.col("_move.chunk")).alias("text"),
            F.col("_move.chunk").alias("chunk"), F.col("_move.eos").alias("eos"),
        )
        moved = cut_lineage(moved)
        scored = moved.join(grade(moved.select("problem_id", "problem", "text")), "problem_id")
        judged = scored.withColumn("reason", stop_reason(threshold=threshold, eos="eos"))
        if it == max_iters - 1:
            judged = judged.withColumn("reason", F.coalesce("reason", F.lit("max_iters")))
        judged = cut_lineage(judged)
        if trees is None:
            log.close()
        done = judged.where(F.col("reason").isNotNull())
        finished.append(_closing(done, it, F.col("reason")))
        active = judged.where(F.col("reason").isNull()).select("problem_id", "problem", "text")
        if it < max_iters - 1 and active.isEmpty():
            break
    return reduce(DataFrame.unionByName, finished)


def _closing(rows: DataFrame, it: int, reason: Column) -> DataFrame:
    # the final grade is that of the returned text, which was just graded
    return rows.select(
        "problem_id", "problem", F.col("text").alias("final_answer"), F.col("score").alias("final_score"),
        F.lit(it).alias("last_iter"), reason.alias("stop_reason"),
    )


def tree_rows(state: DataFrame) -> DataFrame:
    """The array form as one row per node, for the relational operators."""
    return state.select(F.col("problem_id").alias("tree_id"), F.explode("nodes").alias("n")).select("tree_id", "n.*")
