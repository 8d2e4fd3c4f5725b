import hashlib
import math
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veritrail.functions import grader_math as gm
from veritrail.operators import grade, training
from veritrail.session import ship_package
from veritrail.sources import models

SPECS = [
    gm.GraderSpec(6, hidden_dims=(5, 4)),
    gm.GraderSpec(6, hidden_dims=(5, 4), use_batch_norm=True),
    gm.GraderSpec(6, residual=True, hidden_dim=4, num_layers=2, use_layer_norm=True),
    gm.GraderSpec(6, residual=True, hidden_dim=6, num_layers=2),
    gm.GraderSpec(6, hidden_dims=()),
]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(47, 6)).astype(np.float32)
    return x, (x[:, 0] + x[:, 1] > 0).astype(float)


def frame(spark, x, y):
    return spark.createDataFrame([(i, [float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, vec array<float>, label int")


@settings(max_examples=20, deadline=None)
@given(st.floats(-8, 8))
def test_erf(x):
    assert abs(gm.erf(np.array([x]))[0] - math.erf(x)) < 1e-12


def test_clipping():
    g = {"a": np.array([3.0]), "b": np.array([4.0])}
    assert gm.clip_by_norm(g, 10.0)["a"][0] == 3.0 and gm.clip_by_norm(g, 0)["a"][0] == 3.0
    assert gm.clip_by_norm(g, 1.0)["b"][0] == pytest.approx(0.8, abs=1e-6)


def loss_and_grad(w, x, y):
    x = np.column_stack([x.astype(np.float64), np.ones(len(y))])
    z = x @ w
    loss = np.mean(np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z))))
    return float(loss), x.T @ (1 / (1 + np.exp(-z)) - y) / len(y)


def test_gradient_by_finite_differences(spark, data):
    x, y = data
    w = np.random.default_rng(1).normal(size=7)
    rows = frame(spark, x, y).selectExpr("vec", "cast(label as double) label", "id div 20 batch_id")
    got = training.step_sums(rows, w, 4).first()
    parts = [slice(0, 20), slice(20, 40), slice(40, 47)]

    def total(v):
        return sum(loss_and_grad(v, x[p], y[p])[0] for p in parts)

    assert got.loss == pytest.approx(total(w)) and got.tp + got.fn == y.sum() and got.ends_finite
    for k in range(7):
        step = 1e-6 * np.eye(7)[k]
        assert (total(w + step) - total(w - step)) / 2e-6 / 4 == pytest.approx(got.grad[k], abs=1e-7)


def order(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


def by_hand(x, y, config):
    """The same training in one process, batch by batch."""
    ids = order(range(len(y)), config.seed)
    n_val = int(len(ids) * config.val_split)
    val, train = ids[:n_val], ids[n_val:]
    p = gm.init_params(gm.GraderSpec(x.shape[1], hidden_dims=()), config.seed)
    adam, held, losses = gm.AdamW(config.weight_decay), None, []
    rate = config.learning_rate
    for epoch in range(1, config.epochs + 1):
        placed = order(train, f"{config.seed}:{epoch}")
        batches = [placed[i : i + config.batch_size] for i in range(0, len(placed), config.batch_size)]
        total = 0.0
        for b, batch in enumerate(batches):
            loss, g = loss_and_grad(np.append(p["out.w"][0], p["out.b"]), x[batch], y[batch])
            if math.isnan(loss):
                continue
            total += loss
            held = g / config.accumulation_steps + (0 if held is None else held)
            if (b + 1) % config.accumulation_steps == 0 or b + 1 == len(batches):
                split = {"out.w": held[None, :-1], "out.b": held[-1:]}
                p, held = adam.update(p, gm.clip_by_norm(split, config.grad_clip), rate), None
        losses.append(total / len(batches))
        rate = 0.1 * config.learning_rate + 0.9 * config.learning_rate * (1 + math.cos(math.pi * epoch / config.epochs)) / 2
    return p, losses, val


@pytest.mark.parametrize("clip", [1.0, 0.05])
def test_distributed_training_equals_one_process(spark, data, clip):
    x, y = data
    config = training.TrainConfig(val_split=0.1, batch_size=8, epochs=2, learning_rate=0.01, accumulation_steps=2, grad_clip=clip)
    ready = training.prepare(frame(spark, x, y).repartition(3), config)
    got = training.train_grader(ready)
    p, losses, val = by_hand(x, y, config)
    assert all(np.allclose(got.last["run"].params[k], p[k], atol=1e-9) for k in p)
    history = got.history.orderBy("epoch").collect()
    assert [r.train_loss for r in history] == pytest.approx(losses, abs=1e-9)
    assert sorted(r.id for r in ready.val.collect()) == sorted(val)
    assert ready.n_train == 43 and history[0].train_metrics.tp + history[0].train_metrics.fn == int(y[[i for i in range(47) if i not in val]].sum())
    ready.close()


@pytest.mark.parametrize("bad", [3, 11, 20, 40])
def test_batches_with_nan_are_skipped(spark, data, bad):
    x, y = data[0].copy(), data[1]
    x[bad] = np.nan
    config = training.TrainConfig(val_split=0.0, batch_size=8, epochs=2, learning_rate=0.01, accumulation_steps=3)
    got = training.train_grader(training.prepare(frame(spark, x, y), config))
    p, losses, _ = by_hand(x, y, config)
    assert all(np.isfinite(v).all() and np.allclose(v, p[k], atol=1e-9) for k, v in got.last["run"].params.items())
    assert [r.train_loss for r in got.history.orderBy("epoch").collect()] == pytest.approx(losses, abs=1e-9)


def test_skipped_boundary_carries_gradients_over():
    run = training._Run(training.TrainConfig(accumulation_steps=2), {"out.w": np.zeros((1, 1)), "out.b": np.zeros(1)}, gm.AdamW())
    training.apply_step(run, np.array([0.25, 0.25]), False, 0.1)
    assert run.optimiser.step == 0 and run.carried.tolist() == [0.25, 0.25]
    training.apply_step(run, np.array([0.5, 0.5]), True, 0.1)
    assert run.optimiser.step == 1 and run.carried is None
    assert run.optimiser.mean["out.b"][0] == pytest.approx(0.1 * 0.75 * min(1, 1 / (0.75 * math.sqrt(2) + 1e-6)))


def test_partitioning_does_not_matter(spark, data):
    config = training.TrainConfig(batch_size=16, epochs=1, accumulation_steps=2)
    runs = [training.train_grader(training.prepare(frame(spark, *data).repartition(n), config)) for n in (1, 5)]
    a, b = (r.last["run"].params for r in runs)
    assert all(np.allclose(a[k], b[k], atol=1e-12) for k in a)


def test_rows_of_a_step_are_not_shuffled(spark, data):
    rows = frame(spark, *data).selectExpr("vec", "cast(label as double) label", "id div 8 batch_id")
    plan = training.step_sums(rows, np.ones(7), 2)._jdf.queryExecution().executedPlan().toString()
    for exchange in plan.split("Exchange ")[1:]:
        assert "Aggregate" in exchange.split("\n")[1]  # only partial aggregates travel
    assert "Python" not in plan and "InPandas" not in plan


def test_missing_labels_and_empty_tables_are_refused(spark, data):
    config = training.TrainConfig(epochs=1)
    with pytest.raises(Exception, match="must have a label"):
        training.prepare(frame(spark, *data).selectExpr("id", "vec", "nullif(label, 1) label"), config)
    with pytest.raises(ValueError, match="one width"):
        training.prepare(frame(spark, *data).limit(0), config)


def test_checkpoints_of_best_and_last(spark, data, tmp_path):
    config = training.TrainConfig(batch_size=16, epochs=2, accumulation_steps=1, learning_rate=0.05)
    got = training.train_grader(training.prepare(frame(spark, *data), config), on_epoch=models.checkpoint_saver(spark, str(tmp_path)))
    last = models.load_grader(spark, f"{tmp_path}/run/last")
    assert all(np.array_equal(last.params[k], got.last["run"].params[k]) for k in last.params)
    assert got.best_epoch["run"] is not None
    best = models.load_grader(spark, f"{tmp_path}/run/best")
    assert all(np.array_equal(best.params[k], got.best["run"].params[k]) for k in best.params)
    models.write_history(got, f"{tmp_path}/h")
    assert models.read_history(spark, f"{tmp_path}/h").count() == 2


def test_sweep_equals_single_runs(spark, data):
    config = training.TrainConfig(batch_size=16, epochs=1, accumulation_steps=4)
    ready = training.prepare(frame(spark, *data), config)
    configs = training.sweep_configs(config)
    some = {k: configs[k] for k in ("fast", "short_steps")}
    both = training.train_graders(ready, some)
    alone = training.train_graders(ready, {"short_steps": configs["short_steps"]})
    assert all(np.allclose(both.last["short_steps"].params[k], w, atol=1e-12) for k, w in alone.last["short_steps"].params.items())
    with pytest.raises(ValueError, match="differs"):
        training.train_graders(ready, {"other": replace(config, batch_size=8)})


@pytest.mark.parametrize("spec", SPECS)
def test_score_equals_numpy(spark, data, spec):
    x, y = data
    grader = grade.Grader(spec, gm.init_params(spec, 5), gm.init_running(spec))
    rows = grade.score(frame(spark, x, y).repartition(3), grader).orderBy("id").collect()
    want = gm.logits(spec, grader.params, x, grader.running)
    assert np.allclose([r.logit for r in rows], want) and np.allclose([r.prob for r in rows], 1 / (1 + np.exp(-want)))


def test_score_of_an_empty_table(spark, data):
    grader = grade.Grader(SPECS[0], gm.init_params(SPECS[0]))
    assert grade.score(frame(spark, *data).limit(0), grader).count() == 0


def test_one_step_takes_all_batches_of_an_epoch_whatever_divides_them(spark, data):
    x, y = data
    config = training.TrainConfig(val_split=0.0, batch_size=4, epochs=1, accumulation_steps=2, step_batches=0, learning_rate=0.01)
    ready = training.prepare(frame(spark, x, y), config)
    fitted = training.train_grader(ready, {"out.w": np.full((1, 6), 0.3), "out.b": np.zeros(1)})
    assert ready.n_batches == 12 and fitted.optimisers["run"].step == 1
    ids = order(range(len(y)), f"{config.seed}:1")
    start = np.array([0.3] * 6 + [0.0])
    grad = sum(loss_and_grad(start, x[ids[k : k + 4]], y[ids[k : k + 4]])[1] for k in range(0, 47, 4)) / 2
    grad *= min(1, 1 / (np.linalg.norm(grad) + 1e-6))
    want = start * (1 - 0.01 * 0.01) - 0.01 * grad / (np.abs(grad) + 1e-8)
    params = fitted.last["run"].params
    assert np.allclose([*params["out.w"][0], params["out.b"][0]], want, atol=1e-12)


def test_runs_of_a_sweep_step_side_by_side(spark, data, monkeypatch):
    config = training.TrainConfig(batch_size=8, epochs=1, accumulation_steps=2)
    ready = training.prepare(frame(spark, *data), config)
    both, own = threading.Barrier(2, timeout=60), training._epoch_of

    def waiting(*args):
        both.wait()
        return own(*args)

    monkeypatch.setattr(training, "_epoch_of", waiting)
    fitted = training.train_graders(ready, {"a": config, "b": replace(config, learning_rate=0.1)})
    assert [r.run for r in fitted.history.collect()] == ["a", "b"] and fitted.optimisers["a"].step == fitted.optimisers["b"].step == 3


def counted(monkeypatch, name):
    calls, own = [], getattr(training, name)
    monkeypatch.setattr(training, name, lambda *args: calls.append(args) or own(*args))
    return calls


def test_runs_of_a_sweep_walk_chunks_and_not_steps(spark, data, monkeypatch):
    x, y = data
    # 24 batches, 10 to a chunk of 480 bytes, in steps of 2, 4 and 8
    monkeypatch.setattr(training, "CHUNK_BYTES", 10 * 2 * 6 * 4, raising=False)
    config = training.TrainConfig(val_split=0.0, batch_size=2, epochs=1, accumulation_steps=4)
    ready, configs = training.prepare(frame(spark, x, y), config), training.sweep_configs(config)
    jobs = counted(monkeypatch, "step_sums")
    got = training.train_graders(ready, configs)
    assert ready.n_batches == 24 and not jobs
    losses = {r.run: r.train_loss for r in got.history.collect()}
    for name, one in configs.items():
        p, want, _ = by_hand(x, y, one)
        assert all(np.allclose(got.last[name].params[k], p[k], atol=1e-9) for k in p) and losses[name] == pytest.approx(want[0], abs=1e-9)


@pytest.mark.parametrize("bad", [None, 3, 11, 20, 40])
def test_short_steps_cost_a_job_to_a_chunk_and_cross_its_end(spark, data, monkeypatch, bad):
    x, y = data[0].copy(), data[1]
    if bad is not None:
        x[bad] = np.nan
    # 12 batches, 5 to a chunk of 480 bytes: the steps of batches 3-5 and 9-11 lie in two chunks each
    monkeypatch.setattr(training, "CHUNK_BYTES", 5 * 4 * 6 * 4, raising=False)
    jobs, chunks = counted(monkeypatch, "step_sums"), counted(monkeypatch, "_chunk_of") if hasattr(training, "_chunk_of") else []
    config = training.TrainConfig(val_split=0.0, batch_size=4, epochs=2, learning_rate=0.01, accumulation_steps=3)
    ready = training.prepare(frame(spark, x, y).repartition(3), config)
    got = training.train_grader(ready)
    assert ready.n_batches == 12 and not jobs and len(chunks) == 2 * 3
    p, losses, _ = by_hand(x, y, config)
    assert all(np.isfinite(v).all() and np.allclose(v, p[k], atol=1e-9) for k, v in got.last["run"].params.items())
    assert [r.train_loss for r in got.history.orderBy("epoch").collect()] == pytest.approx(losses, abs=1e-9)


def test_steps_wider_than_a_chunk_are_aggregates(spark, data, monkeypatch):
    x, y = data
    monkeypatch.setattr(training, "CHUNK_BYTES", 2 * 4 * 6 * 4, raising=False)
    jobs = counted(monkeypatch, "step_sums")
    config = training.TrainConfig(val_split=0.0, batch_size=4, epochs=1, learning_rate=0.01, accumulation_steps=5)
    ready = training.prepare(frame(spark, x, y), config)
    got = training.train_grader(ready)
    p, losses, _ = by_hand(x, y, config)
    assert ready.chunk_batches == 2 and len(jobs) == 3
    assert all(np.allclose(got.last["run"].params[k], p[k], atol=1e-9) for k in p)
    assert got.history.first().train_loss == pytest.approx(losses[0], abs=1e-9)


@pytest.mark.parametrize("odd", [None, np.nan, np.inf, -np.inf, 3e38])
@pytest.mark.parametrize("row", [5, 46])
def test_sums_of_a_chunk_equal_the_aggregates(spark, data, odd, row):
    x, y = data[0].copy(), data[1]
    if odd is not None:
        x[row, 2] = odd
    w = np.random.default_rng(2).normal(size=7) * (1e300 if odd == 3e38 else 1)
    want = training.step_sums(frame(spark, x, y).selectExpr("vec", "cast(label as double) label", "id div 20 batch_id"), w, 4).first()
    grad, loss, cells, ends_finite = gm.batch_sums(x, y, y == 1, np.array([0, 20, 40]), w, 4)
    assert np.allclose(grad, want.grad, rtol=1e-12, atol=1e-12) and loss == pytest.approx(want.loss, rel=1e-12)
    assert cells.tolist() == [want.tp, want.fp, want.tn, want.fn] and ends_finite == want.ends_finite


def test_missing_numbers_in_a_vector_are_refused(spark, data):
    vec = "transform(vec, (v, i) -> if(id = 9 and i = 2, null, v)) vec"
    ready = training.prepare(frame(spark, *data).selectExpr("id", vec, "label"), training.TrainConfig(val_split=0.0, batch_size=8, epochs=1, accumulation_steps=2))
    with pytest.raises(Exception, match="missing numbers"):
        training.train_grader(ready)


def test_the_package_is_sent_once_whichever_threads_ask():
    sent = []

    class Context:
        applicationId = "only this test"

        def addPyFile(self, path):
            sent.append(path)
            time.sleep(0.2)

    session = SimpleNamespace(sparkContext=Context())
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(ship_package, [session] * 4))
    assert len(sent) == 1
