import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veritrail.functions import vectors
from veritrail.operators import encode, prefixes


def brute(length, k, cap, final):
    end = min(length, cap) if cap else length
    out = list(range(k, end + 1, k))
    if final and end % k:
        out.append(end)
    return out


@pytest.mark.parametrize("k", [1, 7, 100])
@pytest.mark.parametrize("cap", [None, 0, 1024, 5])
@pytest.mark.parametrize("final", [True, False])
def test_prefix_lengths(spark, k, cap, final):
    lengths = [0, 1, 2, 5, 99, 100, 101, 250, 1000, 1024, 1025]
    df = spark.createDataFrame([(n,) for n in lengths], "length int")
    rows = df.select("length", prefixes.prefix_lengths(F.col("length"), k, cap, final).alias("p")).collect()
    assert {r.length: r.p for r in rows} == {n: brute(n, k, cap, final) for n in lengths}


def test_prefix_index_rows_and_ids(spark):
    df = spark.createDataFrame([("a", 250), ("b", 0), ("c", 1025)], "id string, length int")
    rows = prefixes.prefix_index(df, max_length=prefixes.MAX_LENGTH).select("id", prefixes.prefix_id("id").alias("pid")).collect()
    assert [r.pid for r in rows if r.id == "a"] == ["a_prefix100", "a_prefix200", "a_prefix250"]
    assert sum(r.id == "c" for r in rows) == 11 and not any(r.id == "b" for r in rows)


def test_prefix_index_cuts_nothing_unless_told(spark):
    df = spark.createDataFrame([(5000,)], "length int")
    assert prefixes.prefix_index(df).agg(F.max("prefix_length")).first()[0] == 5000


@pytest.fixture(scope="module")
def sequences(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(0, 20, n).tolist()) for i, n in enumerate([1, 4, 5, 6, 23])]
    return rows, spark.createDataFrame(rows, "id long, ids array<int>").withColumn(
        "ends", prefixes.prefix_lengths(F.size("ids"), 5, None)
    )


@pytest.fixture(scope="module")
def matrix():
    return np.random.default_rng(4).normal(size=(20, 6)).astype(np.float32)


@pytest.fixture(scope="module")
def table(spark, matrix):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(matrix)], "row long, vec array<float>")


def expected_states(rows, matrix):
    return {
        (i, p): matrix[np.array(ids[:p])].astype(float).mean(0) for i, ids in rows for p in brute(len(ids), 5, None, True)
    }


def test_states_by_encoder_joins_and_long_table_agree(spark, sequences, matrix, table):
    rows, df = sequences
    want = expected_states(rows, matrix)
    factory = encode.table_encoder(df, encode.embedding_matrix(table, "row", "vec"))
    by_encoder = encode.states_at(df, ["id"], "ids", "ends", factory)
    by_joins = encode.TableStates(table, "row", "vec", max_bytes=0).at(df, ["id"], "ids", "ends", 5)
    long = encode.all_states(df, ["id"], "ids", factory)
    index = df.select("id", F.explode("ends").alias("prefix_length"))
    by_table = prefixes.last_states(long, index)
    for got in (by_encoder, by_joins, by_table):
        states = {(r.id, r.prefix_length): np.array(r.vec) for r in got.collect()}
        assert states.keys() == want.keys()
        assert all(np.allclose(states[key], want[key]) for key in want)
    assert long.count() == sum(len(ids) for _, ids in rows)


def test_final_state_skips_empty(spark, matrix, table):
    df = spark.createDataFrame([(1, [3, 4]), (2, [])], "id long, ids array<int>")
    for limit in (0, 10_000):
        rows = encode.TableStates(table, "row", "vec", max_bytes=limit).final(df, ["id"], "ids").collect()
        assert [r.id for r in rows] == [1] and np.allclose(rows[0].vec, matrix[[3, 4]].astype(float).mean(0))


def test_large_vector_table_is_not_shipped(spark, table):
    assert encode.embedding_matrix(table, "row", "vec", max_bytes=100) is None


def test_masked_mean_pool(spark, matrix, table):
    df = spark.createDataFrame([(1, [3, 4, 3], [1, 0, 1]), (2, [5], [0]), (3, [], [])], "id long, ids array<int>, mask array<int>")
    a = {r.id: np.array(r.vec) for r in encode.masked_mean_pool(df, "id", "ids", "mask", encode.TokenVectors(matrix)).collect()}
    b = {r.id: np.array(r.vec) for r in encode.masked_mean_pool_join(df, "id", "ids", "mask", table, "row", "vec").collect()}
    want = {1: matrix[3], 2: np.zeros(6), 3: np.zeros(6)}
    for key in want:
        assert np.allclose(a[key], want[key], atol=1e-6) and np.allclose(b[key], want[key], atol=1e-6)


def test_class_vector_and_first_position(spark):
    df = spark.createDataFrame([(1, 0, 1, [1.0, 2.0]), (1, 1, 1, [3.0, 4.0])], "id long, pos int, mask int, vec array<float>")
    classed = vectors.class_vector_row(df, "id", [9.0, 8.0])
    assert sorted((r.pos, r.mask, r.vec) for r in classed.collect()) == [(0, 1, [9.0, 8.0]), (1, 1, [1.0, 2.0]), (2, 1, [3.0, 4.0])]
    assert [r.vec for r in vectors.first_position(classed).collect()] == [[9.0, 8.0]]


def test_half_precision(spark):
    df = spark.createDataFrame([([0.1, 1 / 3],)], "vec array<float>")
    assert encode.to_half(df).first().vec == [float(np.float32(np.float16(v))) for v in (0.1, 1 / 3)]


def test_vector_functions(spark):
    x = np.array([1.0, -2.0, 3.0, 0.5])
    w = np.arange(8.0).reshape(2, 4)
    df = spark.createDataFrame([(x.tolist(),)], "v array<double>")
    row = df.select(
        vectors.rms_normalise(F.col("v")).alias("rms"), vectors.rms_normalise(F.col("v"), vectors.constant_vector([2, 1, 1, 1])).alias("weighted"),
        vectors.layer_normalise(F.col("v")).alias("layer"), vectors.affine(F.col("v"), w, [1, 2]).alias("affine"),
        vectors.width_adapter(F.col("v"), 4, w).alias("adapted"), vectors.width_adapter(F.col("v"), 2, w).alias("same"),
        vectors.sigmoid(F.lit(0.0)).alias("half"),
    ).first()
    rms = x / np.sqrt((x**2).mean() + 1e-5)
    assert np.allclose(row.rms, rms) and np.allclose(row.weighted, rms * [2, 1, 1, 1])
    assert np.allclose(row.layer, (x - x.mean()) / np.sqrt(x.var() + 1e-5))
    assert np.allclose(row.affine, w @ x + [1, 2]) and np.allclose(row.adapted, w @ rms)
    assert row.same == x.tolist() and row.half == 0.5


def test_width_check(spark):
    df = spark.createDataFrame([([1.0],), ([1.0, 2.0],), (None,)], "vec array<float>")
    r = vectors.width_check(df).first()
    assert (r.n_rows, r.n_missing, r.min_width, r.max_width) == (3, 1, 1, 2)


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_states_go_by_token_id(spark, limit):
    vecs = spark.createDataFrame([(7, [3.0, 1.0]), (0, [1.0, 0.0]), (5, [2.0, 4.0])], "row long, vec array<float>")
    df = spark.createDataFrame([("a", [0, 7, 5], [1, 3])], "id string, ids array<int>, ends array<int>")
    states = encode.TableStates(vecs, "row", "vec", max_bytes=limit)
    rows = {r.prefix_length: list(r.vec) for r in states.at(df, ["id"], "ids", "ends", 1).collect()}
    assert rows[1] == [1.0, 0.0] and np.allclose(rows[3], [2.0, 5 / 3])
    strange = spark.createDataFrame([("a", [0, 1], [2])], "id string, ids array<int>, ends array<int>")
    with pytest.raises(Exception, match="token id 1 has no vector"):
        states.at(strange, ["id"], "ids", "ends", 2).collect()
    with pytest.raises(ValueError, match="two vectors"):
        encode.TableStates(vecs.union(vecs), "row", "vec", max_bytes=limit)


def test_prefix_sums_plan_does_not_grow_with_width(spark):
    import time

    width = 2048
    vecs = spark.range(3).select(F.col("id").alias("row"), F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: (i + F.col("id")).cast("float")).alias("vec"))
    df = spark.createDataFrame([("a", [0, 1, 2, 2], [2, 4])], "id string, ids array<int>, ends array<int>")
    start = time.time()
    rows = encode.TableStates(vecs, "row", "vec", max_bytes=0).at(df, ["id"], "ids", "ends", 2).collect()
    assert time.time() - start < 5
    assert {r.prefix_length: (len(r.vec), round(r.vec[0], 9)) for r in rows} == {2: (width, 1.5), 4: (width, 2.25)}


class CountingModel:
    """Running mean of the ids on padded batches, which notes the shape of every call."""

    def __init__(self):
        self.calls = []

    def __call__(self, ids, mask):
        self.calls.append(ids.shape)
        assert (ids[mask == 0] == 99).all()
        return (np.cumsum(ids * mask, axis=1) / np.maximum(np.cumsum(mask, axis=1), 1))[:, :, None]


def test_batch_encoder_sorts_pads_and_keeps_to_its_budget():
    rng = np.random.default_rng(4)
    sequences = [rng.integers(0, 50, n) for n in rng.permutation(np.r_[np.arange(1, 200), 5000, 1, 1])]
    model = CountingModel()
    got = dict(encode.BatchEncoder(model, batch_size=12, token_budget=1500, pad_id=99).runs(sequences))
    assert sorted(got) == list(range(len(sequences)))
    for k, s in enumerate(sequences):
        assert got[k][:, 0] == pytest.approx(np.cumsum(s) / np.arange(1, len(s) + 1))
    assert all(b <= 12 and (b * w <= 1500 or b == 1) for b, w in model.calls)
    model.calls.clear()
    dict(encode.BatchEncoder(model, batch_size=12, pad_id=99).runs(sequences))
    assert len(model.calls) <= len(sequences) / 12 + 1
    assert list(encode.BatchEncoder(model).runs([])) == []


def test_batched_and_single_states_agree(spark):
    rows = [(i, [int(x) for x in np.arange(i % 9) * (i + 1) % 7]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, ids array<int>").withColumn("ends", prefixes.prefix_lengths(F.size("ids"), 3))

    def single():
        return lambda ids: (np.cumsum(ids) / np.arange(1, len(ids) + 1))[:, None]

    def batched():
        # workers cannot import this module
        def model(ids, mask):
            return (np.cumsum(ids * mask, axis=1) / np.maximum(np.cumsum(mask, axis=1), 1))[:, :, None]

        return encode.BatchEncoder(model, batch_size=4, pad_id=99)

    for run in (lambda f: encode.states_at(df, ["id"], "ids", "ends", f), lambda f: encode.all_states(df, ["id"], "ids", f), lambda f: encode.final_state(df, ["id"], "ids", f)):
        def key(r):
            return tuple(x for x in r if not isinstance(x, list))

        one, many = ({key(r): r.vec for r in run(f).collect()} for f in (single, batched))
        assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k]) for k in one)


def test_blocks_send_a_vector_once_and_give_the_shipped_states(spark, monkeypatch):
    rng = np.random.default_rng(3)
    table = spark.createDataFrame([(t * 2, [float(v) for v in rng.normal(size=5).astype(np.float32)]) for t in range(30)], "row long, vec array<float>")
    rows = [(i, [int(t) * 2 for t in rng.integers(0, 30, n)]) for i, n in enumerate([0, 1, 7, 40, 250, 3, 0, 90])]
    df = spark.createDataFrame([*rows, (99, None)], "id long, ids array<int>").coalesce(2)
    df = df.withColumn("ends", prefixes.prefix_lengths(F.coalesce(F.size("ids"), F.lit(0)), 10)).withColumn("mask", F.transform("ids", lambda t: F.lit(1)))
    sent = []

    def counting(facts, lookup, keys):
        sent.extend(tuple(r) for r in facts.collect())
        return facts.join(lookup, keys)

    monkeypatch.setattr(encode, "lookup_join", counting)
    joined, shipped = encode.TableStates(table, "row", "vec", max_bytes=0), encode.TableStates(table, "row", "vec")
    monkeypatch.setattr(encode.with_block_vectors, "__defaults__", (20, 64))
    a, b = ({(r.id, r.prefix_length): r.vec for r in s.at(df, ["id"], "ids", "ends", 10).collect()} for s in (joined, shipped))
    assert a == b and len(a) == 41
    assert len(sent) == len(set(sent)) and len({block for block, _ in sent}) > 3
    pooled = {r.id: r.vec for r in encode.masked_mean_pool_join(df, "id", "ids", "mask", table, "row", "vec").collect()}
    assert pooled.keys() == {0, 1, 2, 3, 4, 5, 6, 7, 99} and pooled[0] == pooled[99] == [0.0] * 5
    assert np.allclose(pooled[4], b[4, 250])


def test_half_precision_needs_no_python_and_equals_numpy(spark):
    bits = np.random.default_rng(3).integers(0, 1 << 32, 20_000, dtype=np.uint64).astype(np.uint32)
    small = np.arange(0, 1 << 16, dtype=np.uint16).view(np.float16).astype(np.float32)
    with np.errstate(all="ignore"):
        between = (small[:-1] + small[1:]) / 2
        near = np.concatenate([np.nextafter(between, np.float32(0)), np.nextafter(between, np.float32(9e9))])
        values = np.concatenate([bits.view(np.float32), small, between, near])
        want = values.astype(np.float16).astype(np.float32)
    halved = encode.to_half(spark.createDataFrame([(values.tolist(),)], "vec array<float>"))
    assert "Python" not in halved._jdf.queryExecution().executedPlan().toString()
    got = np.array(halved.first().vec, dtype=np.float32)
    assert np.array_equal(got, want, equal_nan=True) and (np.signbit(got) == np.signbit(want))[~np.isnan(want)].all()


def test_states_leave_python_in_bounded_arrow_batches(spark):
    vectors_of = encode.TokenVectors(np.random.default_rng(1).normal(size=(50, 64)).astype(np.float32))
    lists = [list(range(n % 50)) * (n % 7) for n in range(3_000)]
    ends = [list(range(1, len(ids) + 1)) if len(ids) else None for ids in lists]
    batch = pa.RecordBatch.from_pydict({"id": list(range(3_000)), "ids": pa.array(lists, pa.list_(pa.int32())), "ends": pa.array(ends, pa.list_(pa.int32()))})
    encoder = encode.running_mean_encoder(vectors_of)
    parts = list(encode._state_rows(batch, ["id"], "ids", "ends", encoder))
    assert max(len(p) for p in parts) * 64 <= (1 << 20) + 300 * 64 and len(parts) > 5
    rows = pa.Table.from_batches(parts)
    want = [(i, n) for i, e in enumerate(ends) for n in e or ()]
    assert list(zip(rows["id"].to_pylist(), rows["prefix_length"].to_pylist())) == want
    whole = np.concatenate([encoder(np.array(ids)) for ids in lists if ids])
    assert np.array_equal(rows["vec"].combine_chunks().flatten().to_numpy().reshape(-1, 64), whole)
