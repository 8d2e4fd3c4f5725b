import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.functions import grader_math as gm
from veritrail.functions import tokens
from veritrail.operators import encode, grade
from veritrail.plans import jobs
from veritrail.sources import models, records, results, shards


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_records_skip_blank_lines_and_coerce(spark, tmp_path):
    rows = [
        {"question": "q é", "answer": "a", "is_correct": True, "source": "s"},
        {"question": 3, "answer": None, "is_correct": "false"},
        {"question": "x", "answer": "y", "is_correct": None},
    ]
    path = write(tmp_path / "r.jsonl", "\n\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n \t \n")
    got = records.record_columns(records.read_records(spark, path)).collect()
    assert sorted(r.record_id for r in got) == [0, 1, 2]
    got.sort(key=lambda r: r.record_id)
    assert [(r.question, r.answer, r.label_correct, r.source) for r in got] == [
        ("q é", "a", 1, "s"), ("3", "None", 1, None), ("x", "y", 0, None)
    ]
    strict = records.record_columns(records.read_records(spark, path), strict=True).collect()
    assert {r.record_id: r.label_correct for r in strict} == {0: 1, 1: 0, 2: None}


def test_copies_keep_ids_of_their_own(spark, tmp_path):
    line = '{"question": "q", "answer": "a", "is_correct": 1}\n'
    write(tmp_path / "a.jsonl", line * 30)
    write(tmp_path / "b.jsonl", line * 20)
    rows = records.record_columns(records.read_records(spark, f"{tmp_path}/*.jsonl"))
    corpus = jobs.tokenised_corpus(rows, "record_id", tokens.hash_tokeniser(50), jobs.CorpusConfig())
    assert sorted(r.ordinal for r in corpus.collect()) == list(range(50))


def test_missing_key_fails_and_null_passes(spark, tmp_path):
    path = write(tmp_path / "r.jsonl", '{"question": "q", "answer": "a"}\n')
    with pytest.raises(ValueError, match="1 records"):
        records.read_records(spark, path)


def test_malformed_json_fails(spark, tmp_path):
    path = write(tmp_path / "r.jsonl", '{"question": "q", "answer": "a", "is_correct": tru\n')
    with pytest.raises(Exception):
        records.record_columns(records.read_records(spark, path)).collect()


@pytest.mark.parametrize("first", [None, 2])
def test_problems_in_file_order(spark, tmp_path, first):
    text = 'Question,Answer\n"Is ""x"",\nreal?",1\nsecond é,2\nthird,3\n'
    path = write(tmp_path / "p.csv", text)
    rows = records.read_problems(spark, path, first=first).orderBy("problem_idx").collect()
    want = ['Is "x",\nreal?', "second é", "third"][:first]
    assert [(r.problem_idx, r.problem) for r in rows] == list(enumerate(want))


def test_shards_catalog_and_join(spark, tmp_path):
    df = spark.range(9).select(F.col("id").alias("ordinal"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("text"))
    placed = shards.place_samples(df, "ordinal", 4)
    shards.write_shards(placed, f"{tmp_path}/s", 4)
    stored = spark.read.parquet(f"{tmp_path}/s")
    assert [r["count"] for r in stored.groupBy("shard_idx").count().orderBy("shard_idx").collect()] == [4, 4, 1]
    assert len(list((tmp_path / "s").glob("shard_idx=*/*.parquet"))) == 3
    shards.write_catalog(placed, f"{tmp_path}/c", ["id", "shard_file", "shard_idx", "local_idx", "text", "ordinal"])
    lines = [json.loads(x) for f in sorted((tmp_path / "c").glob("part-*")) for x in f.read_text(encoding="utf-8").splitlines()]
    assert [x["id"] for x in lines] == [f"ex_{i:06d}" for i in range(9)] and lines[3]["text"] == "é3"
    catalog = spark.read.json(f"{tmp_path}/c").drop("text")
    met = shards.payload_of(catalog, stored.select("shard_idx", "local_idx", "text")).collect()
    assert {r.id: r.text for r in met} == {f"ex_{i:06d}": f"é{i}" for i in range(9)}
    assert {r.shard_file for r in shards.shard_files(catalog).collect()} == {"shard_0000.pt", "shard_0001.pt", "shard_0002.pt"}


def test_metadata_wins(spark):
    df = spark.createDataFrame([("mine", 1)], "id string, ordinal long")
    row = shards.override(df, {"id": F.lit("base"), "other": F.lit("base")}).first()
    assert row.id == "mine" and row.other == "base"
    assert shards.place_samples(df, "ordinal", 4).first().id == "mine"
    left, right = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(1)), F.create_map(F.lit("b"), F.lit(2))
    assert spark.range(1).select(shards.merge_maps(left, right).alias("m")).first().m == {"a": 1, "b": 2}


def test_corpus_to_prefix_vectors(spark, tmp_path):
    rng = np.random.default_rng(0)
    matrix = rng.normal(size=(50, 4))
    rows = [(i, f"q{i}", " ".join(f"w{j}" for j in range(n)), i % 2) for i, n in enumerate([0, 3, 40, 200])]
    df = spark.createDataFrame(rows, "id long, question string, answer string, label_correct int")
    corpus = jobs.tokenised_corpus(df, "id", tokens.hash_tokeniser(50), jobs.CorpusConfig())
    factory = encode.table_encoder(df, encode.TokenVectors(matrix))
    catalog, summary = jobs.extract_prefix_vectors(corpus, f"{tmp_path}/v", encode.EncoderStates(factory), 50, 1024, samples_per_shard=3)
    total = sum(-(-r.length // 50) for r in corpus.collect())
    listed = catalog.orderBy("sample_id").collect()
    assert [r.sample_id for r in listed] == [f"sample_{i:07d}" for i in range(total)]
    assert [(r.original_id, r.prefix_length) for r in listed] == sorted((r.original_id, r.prefix_length) for r in listed)
    s = summary.first()
    assert (s.total_samples, s.total_shards, s.samples_per_shard, s.dtype) == (total, -(-total // 3), 3, "torch.float16")
    vectors = shards.read_vector_shards(spark, f"{tmp_path}/v")
    ids = {r.id: r.ids for r in corpus.collect()}
    for r in vectors.collect():
        want = matrix[np.array(ids[r.original_id][: r.prefix_length])].mean(0)
        assert np.allclose(r.vec, want.astype(np.float32).astype(np.float16), atol=1e-3)
    stats = shards.storage_stats(spark, f"{tmp_path}/v/vectors").first()
    files = list((tmp_path / "v" / "vectors").rglob("*.parquet"))
    assert stats.total_bytes == sum(f.stat().st_size for f in files) and stats.n_files == len(files)
    jobs.write_state_shards(corpus, f"{tmp_path}/t", factory, ["question", "label_correct", "length"], size=2)
    states = spark.read.parquet(f"{tmp_path}/t/states")
    assert states.count() == sum(len(v) for v in ids.values())
    again = spark.read.json(f"{tmp_path}/t/catalog")
    assert sorted((r.id, r.shard_idx, r.local_idx) for r in again.collect()) == [(f"ex_{i:06d}", i // 2, i % 2) for i in range(4)]


def test_vectors_are_made_and_written_once(spark, tmp_path):
    """Every sequence reaches the encoder once, and what is written beside the shards holds no vector."""
    calls = spark.sparkContext.accumulator(0)

    def factory():
        def model(ids):
            calls.add(1)
            return np.cumsum(np.ones((len(ids), 3)), axis=0)

        return model

    rows = [(i, f"q{i}", " ".join(f"w{j}" for j in range(i)), i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, question string, answer string, label_correct int")
    corpus = jobs.tokenised_corpus(df, "id", tokens.hash_tokeniser(50), jobs.CorpusConfig())
    catalog, _ = jobs.extract_prefix_vectors(corpus, f"{tmp_path}/v", encode.EncoderStates(factory), 10, samples_per_shard=7)
    assert calls.value == 30
    want = [(f"ex_{r.ordinal:06d}", n) for r in corpus.orderBy("ordinal").collect() for n in [*range(10, r.length, 10), r.length]]
    assert [(r.original_id, r.prefix_length) for r in catalog.orderBy("sample_id").collect()] == want
    counts = shards.storage_counts(spark, f"{tmp_path}/v/vectors").first()
    assert (counts.n_rows, counts.n_files, counts.most_rows) == (len(want), -(-len(want) // 7), 7)


def test_checkpoints_keep_the_newest_whole_versions(spark, tmp_path):
    spec = gm.GraderSpec(in_dim=2)
    path = f"{tmp_path}/last"
    for k in range(4):
        models.save_checkpoint(spark, path, "run", k, grade.Grader(spec, {"out.w": np.full((1, 2), float(k)), "out.b": np.zeros(1)}))
    assert len(models.versions(spark, path)) == models.KEPT_VERSIONS == len(list((tmp_path / "last").iterdir()))
    # a version that was never committed is not loaded
    broken = tmp_path / "last" / f"saved_at={10**19}"
    broken.mkdir()
    assert models.load_grader(spark, path).params["out.w"].tolist() == [[3.0, 3.0]]
    with pytest.raises(FileNotFoundError):
        models.load_grader(spark, f"{tmp_path}/none")


def test_uneven_vectors_fail(spark, tmp_path):
    spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "vec array<float>").write.parquet(f"{tmp_path}/vectors")
    with pytest.raises(ValueError, match="uneven"):
        shards.read_vector_shards(spark, str(tmp_path))


def test_checkpoint_round_trip(spark, tmp_path):
    spec = gm.GraderSpec(in_dim=5, hidden_dims=(4, 3), use_batch_norm=True)
    params = gm.init_params(spec, 7)
    running = {k: v + 0.5 for k, v in gm.init_running(spec).items()}
    adam = gm.AdamW()
    adam.update(params, params, 0.1)
    path = f"{tmp_path}/c"
    models.save_checkpoint(spark, path, "run", 3, grade.Grader(spec, params, running), adam, 0.5)
    loaded = models.load_grader(spark, path)
    assert loaded.spec == spec
    assert all(np.array_equal(loaded.params[k], params[k]) for k in params)
    assert all(np.array_equal(loaded.running[k], running[k]) for k in running)


def test_stored_arguments_take_defaults():
    spec = gm.GraderSpec.from_args({}, in_dim=9)
    assert (spec.residual, spec.hidden_dims, spec.hidden_dim, spec.num_layers, spec.dropout) == (False, (512, 256), 512, 3, 0.1)
    assert not spec.use_layer_norm and not spec.use_batch_norm


def test_results_append_and_summary(spark, tmp_path):
    def done(i):
        return spark.createDataFrame([(i, "p", "é", 0.25 * i)], results.RESULT)

    results.append_results(done(1), f"{tmp_path}/r")
    results.append_results(done(2), f"{tmp_path}/r")
    back = spark.read.schema(results.RESULT).json(f"{tmp_path}/r")
    row = results.result_summary(back, {"k": 5}).first()
    assert (row.num_problems, row.avg_final_score, row.config) == (2, 0.375, {"k": "5"})
    empty = results.result_summary(back.limit(0)).first()
    assert empty.num_problems == 0 and empty.avg_final_score is None and empty.config == {}
