"""Registered queries: each operator over the given tables.

Every query reads whole tables and gives flat columns with floats rounded, so
results can be compared across engines.
"""

from __future__ import annotations

from contextlib import suppress

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions import chat, grader_math, search, text, tokens, vectors
from veritrail.operators import encode, grade, guided, metrics, ordering, prefixes, training, tree
from veritrail.plans import jobs
from veritrail.plans.tables import (
    candidate_log,
    commerce_tree,
    dialogue,
    document_lengths,
    hashed,
    labelled,
    sentence_pool,
    table,
)
from veritrail.session import scratch_path, spread, written_table
from veritrail.sources import models, results, shards
from veritrail.streaming import live

VOCAB = 32000
SMALL_VOCAB = 16
EOS = 3
MOST_BATCHES = 8


def _rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# --- chats, labels, tokens


def chat_render_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    msgs = chat.chat_messages(chat.system_prompt("corpus"), text.as_text("question"), text.as_text("answer"))
    return dialogue(spark, sf_dir, True).select("conv_id", "turn", chat.render_chat(msgs, "closed").alias("rendered"))


def chat_render_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    msgs = chat.chat_messages(chat.system_prompt("search"), F.col("question"))
    return dialogue(spark, sf_dir, False).select("conv_id", "turn", chat.render_chat(msgs, "generation").alias("rendered"))


def chat_render_continue(spark: SparkSession, sf_dir: str) -> DataFrame:
    msgs = chat.chat_messages(chat.system_prompt("search"), F.col("question"), F.col("answer"))
    return dialogue(spark, sf_dir, True).select("conv_id", "turn", chat.render_chat(msgs, "continue").alias("rendered"))


def label_truthiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.parse_json("props")
    events = table(spark, sf_dir, "events").select(
        F.lit("event").alias("origin"), F.col("event_id").alias("row_id"),
        text.truthy(F.try_variant_get(raw, "$.k", "variant")).alias("as_number"),
        text.truthy(F.parse_json(F.concat(F.lit('"'), F.get_json_object("props", "$.k"), F.lit('"')))).alias("as_text"),
        text.truthy(raw).alias("as_object"),
        text.truthy(F.try_variant_get(raw, "$.absent", "variant")).alias("as_missing"),
    )
    flag = F.parse_json((F.col("quality") == 1).cast("string"))
    labels = table(spark, sf_dir, "labels").select(
        F.lit("label").alias("origin"), F.col("doc_id").alias("row_id"),
        text.truthy(F.parse_json(F.col("quality").cast("string"))).alias("as_number"),
        text.truthy(F.parse_json(F.concat(F.lit('"'), (F.col("toxic") == 1).cast("string"), F.lit('"')))).alias("as_text"),
        text.truthy(F.parse_json(F.when(F.col("toxic") == 1, F.lit('{"t": 1}')).otherwise(F.lit("[]")))).alias("as_object"),
        text.truthy(flag).alias("as_missing"),
    )
    return events.unionByName(labels)


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(tokens.split_tokens("text")).alias("pos", "token"))
    return items.withColumn("token_id", tokens.token_id(F.col("token"), VOCAB))


def decode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", tokens.split_tokens("text").alias("toks"))
    vocabulary = (
        items.select(F.explode("toks").alias("token")).distinct()
        .groupBy(tokens.token_id(F.col("token"), VOCAB).alias("token_id")).agg(F.min("token").alias("token"))
    )
    ids = items.select("item_id", tokens.token_ids(F.col("toks"), VOCAB).alias("ids"))
    special = int(spark.range(1).select(tokens.token_id(F.lit("the"), VOCAB)).first()[0])
    return tokens.decode(ids, "item_id", "ids", vocabulary, (special,))


def left_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    docs = docs.select("doc_id", tokens.split_tokens("text").alias("toks"))
    kept = tokens.left_truncate(F.col("toks"), tokens.MAX_LEN)
    return docs.select(
        "doc_id", F.size("toks").alias("n_tokens"), F.size(kept).alias("n_kept"),
        F.get(kept, F.lit(0)).alias("first_token"), F.md5(F.array_join(kept, " ")).alias("kept_md5"),
    )


def pad_mask_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform(tokens.split_tokens("text"), lambda t: tokens.token_id(t, VOCAB) + 1)
    items = ordering.with_seeded_ordinal(table(spark, sf_dir, "benchmark").select("item_id", ids.alias("ids")), "item_id")
    padded = tokens.pad_batch(items.withColumn("batch_id", ordering.batch_id("ordinal", 12)), "ids", "batch_id", 0)
    masked = padded.withColumn("mask", tokens.attention_mask(F.col("padded"), 0))
    masked = masked.withColumn("length", tokens.mask_length(F.col("mask")))
    return masked.select(
        "item_id", "batch_id", "padded_to", "length", F.array_join("padded", ",").alias("padded"),
        F.array_join(tokens.trim_padding(F.col("padded"), F.col("length")), ",").alias("tail"),
        F.array_join(tokens.trim_by_mask(F.col("padded"), F.col("mask")), ",").alias("masked"),
    )


# --- order, shards, batches, splits


def seeded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    placed = ordering.with_seeded_ordinal(docs, "doc_id")
    return placed.select("doc_id", "ordinal", ordering.sample_id("ordinal").alias("id"))


def range_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ordering.with_range_ordinal(orders, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "ordinal")


def shard_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = labelled(spark, sf_dir).select(
        "doc_id", "question", "label_correct", "source", F.size(tokens.split_tokens("answer")).alias("length")
    )
    metadata = ordering.with_seeded_ordinal(records, "doc_id")
    base = {"source": F.lit("catalog"), "origin": F.lit("catalog")}
    placed = shards.place_samples(shards.override(metadata, base), "ordinal", 50)
    return placed.select("id", "shard_file", "shard_idx", "local_idx", "origin", "source", "question", "label_correct", "length")


def catalog_payload_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ordering.with_seeded_ordinal(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    placed = shards.place_samples(docs, "ordinal", 200)
    path = scratch_path(spark, "payload")
    shards.write_shards(placed.select("shard_idx", "local_idx", "ordinal", "doc_id", "text"), path, 200)
    stored = spark.read.parquet(path)
    catalog = shards.place_samples(stored.select("doc_id", "ordinal"), "ordinal", 200)
    met = shards.payload_of(catalog.select("id", "shard_file", "shard_idx", "local_idx"), stored.drop("ordinal"))
    files = shards.shard_files(catalog).withColumn("listed", F.lit(1))
    return met.join(files, "shard_file").select(
        "id", "shard_file", "shard_idx", "local_idx", "doc_id", "listed", F.md5("text").alias("text_md5")
    )


def early_stop_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ordering.first_batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return placed.withColumn("batch_id", ordering.batch_id("ordinal", 12))


def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.with_split(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id")


def split_by_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prefixes.prefix_index(document_lengths(spark, sf_dir))
    return ordering.with_split(rows.select("doc_id", "prefix_length"), ["doc_id", "prefix_length"], group_col="doc_id")


# --- prefixes and states


def prefix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prefixes.prefix_index(document_lengths(spark, sf_dir))
    return rows.select("doc_id", prefixes.prefix_id("doc_id").alias("prefix_id"), "prefix_length", F.col("length").alias("original_length"))


def prefix_index_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes of the first 1024 tokens: the cap is what this query shows."""
    rows = prefixes.prefix_index(document_lengths(spark, sf_dir), max_length=prefixes.MAX_LENGTH)
    return rows.select("doc_id", prefixes.prefix_id("doc_id").alias("prefix_id"), "prefix_length", F.col("length").alias("original_length"))


def prefix_index_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes to the end of each text, without the length cap."""
    rows = prefixes.prefix_index(document_lengths(spark, sf_dir), max_length=None)
    return rows.select("doc_id", prefixes.prefix_id("doc_id").alias("prefix_id"), "prefix_length", F.col("length").alias("original_length"))


def prefix_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", tokens.token_ids(tokens.split_tokens("text"), VOCAB).alias("ids"))
    rows = prefixes.prefix_index(items.withColumn("length", F.size("ids")), stride_k=10, max_length=None)
    cut = prefixes.prefix_slice(F.col("ids"))
    return rows.select("item_id", "prefix_length", F.array_join(cut, ",").alias("ids"), F.size(cut).alias("n_mask"))


def _document_ids(
    spark: SparkSession, sf_dir: str, vocab: int, max_length: int | None = None
) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    docs = docs.select("doc_id", tokens.split_tokens("text").alias("toks"))
    docs = docs.select("doc_id", "toks", F.size("toks").alias("length"))
    ends = prefixes.prefix_lengths(F.col("length"), max_length=max_length)
    # ids are made up to the last wanted prefix end only
    needed = F.slice("toks", F.lit(1), prefixes.effective_length(F.col("length"), max_length))
    return docs.select("doc_id", "length", ends.alias("ends"), tokens.token_ids(needed, vocab).alias("ids"))


def _table_states(spark: SparkSession, sf_dir: str, **limits: int) -> encode.TableStates:
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return encode.TableStates(vecs, "vec_id", "embedding", **limits)


def _prefix_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _table_states(spark, sf_dir)
    docs = _document_ids(spark, sf_dir, states.vocab)
    return states.at(docs, ["doc_id"], "ids", "ends", prefixes.STRIDE_K)


def last_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.long_vector(_prefix_states(spark, sf_dir), ["doc_id", "prefix_length"], "vec")


def last_state_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the length cap of the extraction job: prefixes to the end of each text."""
    states = _table_states(spark, sf_dir)
    docs = _document_ids(spark, sf_dir, states.vocab, None)
    return vectors.long_vector(states.at(docs, ["doc_id"], "ids", "ends", prefixes.STRIDE_K), ["doc_id", "prefix_length"], "vec")


def last_state_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_joins = _table_states(spark, sf_dir, max_bytes=0)
    docs = _document_ids(spark, sf_dir, by_joins.vocab)
    states = by_joins.at(docs, ["doc_id"], "ids", "ends", prefixes.STRIDE_K)
    return vectors.long_vector(states, ["doc_id", "prefix_length"], "vec")


def _gapped_states(spark: SparkSession, sf_dir: str, **limits: int) -> DataFrame:
    """Prefix states over a vector table whose ids have gaps: 1, 4, 7 and so on."""
    vecs = table(spark, sf_dir, "embeddings").select((F.col("vec_id") * 3 + 1).alias("token"), "embedding")
    states = encode.TableStates(vecs, "token", "embedding", **limits)
    docs = _document_ids(spark, sf_dir, states.vocab).withColumn("ids", F.transform("ids", lambda t: t * 3 + 1))
    return vectors.long_vector(states.at(docs, ["doc_id"], "ids", "ends", prefixes.STRIDE_K), ["doc_id", "prefix_length"], "vec")


def last_state_gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gapped_states(spark, sf_dir)


def last_state_gapped_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gapped_states(spark, sf_dir, max_bytes=0)


def _masked_documents(spark: SparkSession, sf_dir: str, vocab: int) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    toks = docs.select("doc_id", tokens.split_tokens("text").alias("toks"))
    return toks.select(
        "doc_id", tokens.token_ids(F.col("toks"), vocab).alias("ids"),
        F.transform("toks", lambda t: (F.length(t) >= 2).cast("int")).alias("mask"),
    )


def masked_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    matrix = encode.embedding_matrix(vecs, "vec_id", "embedding")
    if matrix is None:
        return masked_mean_pool_join(spark, sf_dir)
    docs = _masked_documents(spark, sf_dir, len(matrix))
    return vectors.long_vector(encode.masked_mean_pool(docs, "doc_id", "ids", "mask", matrix), ["doc_id"], "vec")


def masked_mean_pool_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    docs = _masked_documents(spark, sf_dir, vecs.count())
    pooled = encode.masked_mean_pool_join(docs, "doc_id", "ids", "mask", vecs, "vec_id", "embedding")
    return vectors.long_vector(pooled, ["doc_id"], "vec")


def first_position_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    vocab = vecs.count()
    long = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tokens.split_tokens("text")).alias("pos", "token"))
    placed = long.select("doc_id", "pos", F.lit(1).alias("mask"), tokens.token_id(F.col("token"), vocab).cast("long").alias("vec_id"))
    first_token = vectors.first_position(placed).join(vecs, "vec_id").select("doc_id", "vec")
    narrow = placed.select("doc_id", "pos", "mask", F.array(F.lit(0.0)).alias("vec"))
    classed = vectors.class_vector_row(narrow, "doc_id", [0.25])
    counted = classed.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_positions"), F.sum("mask").alias("n_mask"),
        F.max(F.when(F.col("pos") == 0, F.get("vec", F.lit(0)))).alias("class_value"),
    )
    return vectors.long_vector(first_token.join(counted, "doc_id"), ["doc_id", "n_positions", "n_mask", "class_value"], "vec")


def extraction_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, _ = _extraction(spark, sf_dir)
    return catalog.withColumn("label", F.col("label").cast("double"))


def extraction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extraction(spark, sf_dir)[1]


def storage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "extraction")
    _extraction(spark, sf_dir, path)
    return shards.storage_stats(spark, f"{path}/vectors")


def storage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "extraction")
    _extraction(spark, sf_dir, path)
    return shards.storage_counts(spark, f"{path}/vectors")


def shard_scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines in shards of four, so many that names of five digits occur, as a scan by file name meets them."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    numbered = ordering.with_range_ordinal(lines, ["l_orderkey", "l_linenumber"])
    placed = shards.place_samples(numbered, "ordinal", 4).select("shard_file", "shard_idx", "local_idx", "l_orderkey", "l_linenumber")
    return ordering.scan_order(placed)


def _extraction(spark: SparkSession, sf_dir: str, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    states = _table_states(spark, sf_dir)
    corpus = jobs.tokenised_corpus(labelled(spark, sf_dir), "doc_id", tokens.hash_tokeniser(states.vocab), jobs.CorpusConfig())
    return jobs.extract_prefix_vectors(corpus, path or scratch_path(spark, "extraction"), states, samples_per_shard=500)


# --- vectors, graders, metrics


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", vectors.as_double("embedding").alias("vec"))


def vector_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.width_check(_embeddings(spark, sf_dir))


def rms_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    normed = _embeddings(spark, sf_dir).select("vec_id", vectors.rms_normalise(F.col("vec")).alias("vec"))
    return vectors.long_vector(normed, ["vec_id"], "vec")


def layer_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    normed = _embeddings(spark, sf_dir).select("vec_id", vectors.layer_normalise(F.col("vec")).alias("vec"))
    return vectors.long_vector(normed, ["vec_id"], "vec")


def _wave(n_out: int, n_in: int, shift: float, scale: float) -> np.ndarray:
    """Fixed weights ``sin(j * n_in + i + shift) * scale``, as in the SQL."""
    return np.sin(np.arange(n_out * n_in).reshape(n_out, n_in) + shift) * scale


def width_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = _wave(16, 64, 1.0, 0.125)
    adapted = _embeddings(spark, sf_dir).select("vec_id", vectors.width_adapter(F.col("vec"), 64, weights).alias("vec"))
    return vectors.long_vector(adapted, ["vec_id"], "vec")


def linear_weights(dim: int = 64) -> np.ndarray:
    return np.cos(np.arange(dim))


def grade_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = grade.score(_embeddings(spark, sf_dir), grade.linear_grader(linear_weights(), 0.1))
    return _rounded(scored.select("vec_id", "logit", "prob"), "logit", "prob")


def grade_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = grader_math.GraderSpec(in_dim=64, hidden_dims=(8,))
    params = {
        "layer0.w": _wave(8, 64, 1.0, 0.25), "layer0.b": np.cos(np.arange(8)) * 0.1,
        "out.w": _wave(1, 8, 2.0, 1.0), "out.b": np.array([0.05]),
    }
    scored = grade.score(_embeddings(spark, sf_dir), grade.Grader(spec, params))
    return _rounded(scored.select("vec_id", "logit", "prob"), "logit", "prob")


def _residual_grader() -> grade.Grader:
    spec = grader_math.GraderSpec(in_dim=64, residual=True, hidden_dim=4, num_layers=1, use_layer_norm=True)
    params = {
        "proj.w": _wave(4, 64, 1.0, 0.25), "proj.b": np.zeros(4),
        "block0.norm.g": np.ones(4), "block0.norm.b": np.zeros(4),
        "block0.up.w": _wave(16, 4, 2.0, 0.5), "block0.up.b": np.zeros(16),
        "block0.down.w": _wave(4, 16, 3.0, 0.5), "block0.down.b": np.zeros(4),
        "block0.scale": np.array([0.5]), "out.w": _wave(1, 4, 4.0, 1.0), "out.b": np.array([0.05]),
    }
    return grade.Grader(spec, params)


def grade_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = grade.score(_embeddings(spark, sf_dir), _residual_grader())
    return _rounded(scored.select("vec_id", "logit", "prob"), "logit", "prob")


def grade_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors graded by the newest of three saved versions of a grader, read back from the shared folder."""
    newest, folder = _residual_grader(), scratch_path(spark, "grader")
    for epoch, share in enumerate((0.0, 0.5, 1.0)):
        weights = {name: share * w for name, w in newest.params.items()}
        models.save_checkpoint(spark, folder, "residual", epoch, grade.Grader(newest.spec, weights))
    scored = grade.score(_embeddings(spark, sf_dir), models.load_grader(spark, folder, 64))
    return _rounded(scored.select("vec_id", "logit", "prob"), "logit", "prob")


def _hashed_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select(
        "doc_id", "lang", F.col("label_correct").alias("label"),
        (F.pmod(hashed("p", "doc_id"), F.lit(1001)) / 1000.0).alias("prob"),
        ((F.pmod(hashed("z", "doc_id"), F.lit(2001)) - 1000) / 200.0).alias("logit"),
    )


def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = metrics.classification_metrics(_hashed_predictions(spark, sf_dir), by=["lang"])
    return _rounded(rated, "accuracy", "precision", "recall", "f1")


def batch_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hashed_predictions(spark, sf_dir).select("doc_id", "logit", "label")
    parts = []
    for name, epoch in (("epoch1", 1), ("epoch2", 2), ("eval", None)):
        batched = ordering.with_epoch_batches(rows, "doc_id", 32, 42, epoch)
        parts.append(metrics.epoch_loss(batched).withColumn("pass", F.lit(name)))
    return _rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), "loss")


def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"), (day + 1).alias("epoch"), (F.col("value") / 100).alias("prob"),
        (F.get_json_object("props", "$.k").cast("int") >= 50).cast("int").alias("label"),
    )
    history = _rounded(metrics.classification_metrics(rows, by=["run", "epoch"]), "f1").select("run", "epoch", "f1")
    flagged = metrics.with_best_so_far(history)
    per_run = metrics.best_epoch(history).join(history.groupBy("run").agg(F.max("epoch").alias("epochs")), "run")
    rate = metrics.cosine_rate(F.col("epoch"), F.col("epochs"), 1e-3)
    # one row per epoch and run: the number of runs and epochs bounds both sides
    joined = flagged.join(per_run, "run").withColumn("lr", F.round(rate, 9))
    return joined.select("run", "epoch", "f1", "best_before", "is_new_best", "best_epoch", "best_f1", "lr")


def prefix_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a fixed grader separates good from bad documents by prefix length."""
    states = _table_states(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    # labels first: documents without one are never encoded
    docs = _document_ids(spark, sf_dir, states.vocab).join(labels, "doc_id")
    scored = grade.score(states.at(docs, ["doc_id", "label"], "ids", "ends", prefixes.STRIDE_K), grade.linear_grader(linear_weights() * 8, 0.0))
    judged = scored.select("doc_id", "prefix_length", "label", F.round("prob", 6).alias("prob"))
    rated = metrics.classification_metrics(judged, by=["prefix_length"])
    return _rounded(rated, "accuracy", "precision", "recall", "f1")


# --- training


def _training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), "vec", (F.col("label") >= 5).cast("int").alias("label"))


def train_step_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of a linear grader after one epoch that is a single update step."""
    config = training.TrainConfig(val_split=0.0, batch_size=64, epochs=1, accumulation_steps=64, step_batches=0, learning_rate=0.01)
    ready = training.prepare(_training_rows(spark, sf_dir), config)
    fitted = training.train_grader(ready, _start(ready)).last["run"].params
    ready.close()
    values = [*fitted["out.w"][0], fitted["out.b"][0]]
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(values)], "idx int, weight double")


def _start(ready: training.Prepared) -> dict:
    return {"out.w": 0.1 * linear_weights(ready.in_dim)[None, :], "out.b": np.zeros(1)}


def _history(fitted: training.TrainResult) -> DataFrame:
    rows = fitted.history.select(
        "run", "epoch", "train_loss", "lr", "val_loss", F.col("train_metrics.f1").alias("train_f1"), F.col("val_metrics.f1").alias("val_f1")
    )
    return _rounded(rows, "train_loss", "val_loss", "train_f1", "val_f1").withColumn("lr", F.round("lr", 9))


def train_grader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two epochs of several clipped steps of a linear grader."""
    config = training.TrainConfig(batch_size=64, epochs=2, accumulation_steps=4, learning_rate=0.01, grad_clip=0.05)
    ready = training.prepare(_training_rows(spark, sf_dir), config)
    fitted = training.train_grader(ready, _start(ready))
    ready.close()
    return _history(fitted)


def grader_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One epoch of every run of the sweep, and the run with the lowest validation loss."""
    config = training.TrainConfig(batch_size=64, epochs=1, accumulation_steps=4)
    ready = training.prepare(_training_rows(spark, sf_dir), config)
    fitted = training.train_graders(ready, training.sweep_configs(config), _start(ready))
    ready.close()
    rows = _history(fitted)
    best = rows.agg(F.min_by("run", F.struct("val_loss", "run"))).first()[0]  # one row per run and epoch
    return rows.withColumn("best_run", F.lit(best))


# --- searches


def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guided.best_candidates(candidate_log(spark, sf_dir), ["problem_id", "iter"], ["chunk"])


def guided_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guided.replay(candidate_log(spark, sf_dir))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = guided.replay(candidate_log(spark, sf_dir))
    summary = results.result_summary(done, {"threshold": 0.95, "max_iters": 30})
    return _rounded(summary.withColumn("config", F.to_json("config")), "avg_final_score")


def _search_parts(spark: SparkSession, sf_dir: str):
    problems = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("problem_id"), F.col("text").alias("problem"))
    pool = written_table(sentence_pool(spark, sf_dir), "pool")
    states = _table_states(spark, sf_dir)
    return problems, guided.pool_generator(pool, pool.count()), tokens.hash_tokeniser(states.vocab), states


SEARCH_SCALE = 40.0


def guided_rounds(spark: SparkSession, sf_dir: str, log: list | None = None) -> DataFrame:
    problems, generate, tokenise, states = _search_parts(spark, sf_dir)
    grader = grade.linear_grader(linear_weights() * SEARCH_SCALE, 0.0)
    scorer = grade.chat_grader(["problem_id", "cand_idx"], tokenise, states, grader)
    return guided.search(problems, generate, scorer, k=5, threshold=0.8, max_iters=4, log=log, max_new=None)


def _numbered_search(spark: SparkSession, sf_dir: str):
    problems, *parts = _search_parts(spark, sf_dir)
    numbered = ordering.with_range_ordinal(problems, ["problem_id"], "problem_idx")
    return numbered, *parts, grade.linear_grader(linear_weights() * SEARCH_SCALE, 0.0)


def guided_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch job, its published results counted, and how many rounds it committed."""
    problems, generate, tokenise, states, grader = _numbered_search(spark, sf_dir)
    path = scratch_path(spark, "guided-batch")
    summary = jobs.guided_batch(
        problems.drop("problem_id"), path, generate, tokenise, states, grader, threshold=0.8, max_iters=4, max_new=12
    )
    rounds = results.RoundLog(spark, path)
    listed = rounds.results().agg(F.count(F.lit(1)).alias("n_written"), F.countDistinct("problem_idx").alias("n_distinct")).first()
    counts = {**listed.asDict(), "n_rounds": len(rounds.numbers())}
    whole = summary.withColumn("config", F.to_json("config")).withColumns({name: F.lit(n) for name, n in counts.items()})
    return _rounded(whole, "avg_final_score")


def guided_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search that is broken off after two rounds and gone on with: the results of an unbroken one."""
    problems, generate, tokenise, states, grader = _numbered_search(spark, sf_dir)
    named = problems.select("problem_id", "problem")
    scorer = grade.chat_grader(["problem_id", "cand_idx"], tokenise, states, grader)
    path = scratch_path(spark, "guided-resumed")

    def until_third(rows: DataFrame) -> DataFrame:
        if rows.where("round = 2").limit(1).count():
            raise InterruptedError("broken off")
        return generate(rows)

    with suppress(InterruptedError):
        guided.search(named, until_third, scorer, threshold=0.8, max_iters=4, max_new=12, rounds=results.RoundLog(spark, path))
    return guided.search(named, generate, scorer, threshold=0.8, max_iters=4, max_new=12, rounds=results.RoundLog(spark, path))


def unguided_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    problems, generate, tokenise, _ = _search_parts(spark, sf_dir)
    placed = ordering.with_seeded_ordinal(problems, "problem_id").withColumn("batch_id", ordering.batch_id("ordinal", 12))
    return jobs.unguided(placed, generate, tokenise).select(
        "problem_id", "answer_text", "batch_id", "length", "padded_to", F.array_join("ids", ",").alias("ids")
    )


def _batched_running_mean(table_of: encode.TokenVectors) -> encode.BatchEncoder:
    """The default encoder as a model over padded batches."""

    def model(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        seen = table_of.take(np.where(mask == 1, ids, table_of.ids[0])) * mask[:, :, None]
        return np.cumsum(seen, axis=1) / np.maximum(np.cumsum(mask, axis=1), 1)[:, :, None]

    return encode.BatchEncoder(model)


def _batched_factory(spark: SparkSession, sf_dir: str):
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    matrix = encode.embedding_matrix(vecs, "vec_id", "embedding")
    shared = spark.sparkContext.broadcast(matrix)
    return lambda: _batched_running_mean(shared.value)


def unguided_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog of the baseline's state shards, with what the shards hold for each sample."""
    problems, generate, tokenise, _ = _search_parts(spark, sf_dir)
    path = scratch_path(spark, "unguided")
    catalog = jobs.unguided_states(problems, path, generate, tokenise, _batched_factory(spark, sf_dir), size=20)
    states = spark.read.parquet(f"{path}/states")
    held = states.groupBy("shard_idx", "local_idx").agg(
        F.count(F.lit(1)).alias("n_states"), F.max("pos").alias("last_pos"),
        F.round(F.max_by(F.get("vec", F.lit(0)), "pos").cast("double"), 4).alias("last_value"),
    )
    return shards.payload_of(catalog, held).select(
        "id", "shard_file", "shard_idx", "local_idx", "problem_id", "length", "padded_to", "n_states", "last_pos", "last_value"
    )


def last_state_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States at the ends of whole texts by an encoder that is called on padded batches."""
    vocab = table(spark, sf_dir, "embeddings").count()
    docs = _document_ids(spark, sf_dir, vocab)
    states = encode.EncoderStates(_batched_factory(spark, sf_dir)).final(docs, ["doc_id", "length"], "ids")
    return vectors.long_vector(states, ["doc_id", "length"], "vec")


def sequence_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = tokens.token_ids(tokens.split_tokens("text"), SMALL_VOCAB)
    items = table(spark, sf_dir, "benchmark").select("item_id", ids.alias("ids"))
    items = items.withColumn("new", tokens.new_tokens(F.col("ids"), F.lit(3)))
    step = F.transform(
        "new",
        lambda _, t: -F.pmod(
            F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("lp"), F.col("item_id").cast("string"), t.cast("string"))), 1, 8), 16, 10).cast("long"),
            F.lit(1000),
        ) / 100.0,
    )
    return items.select(
        "item_id", F.size("new").alias("n_new"), tokens.has_eos(F.col("new"), EOS).alias("eos"),
        F.round(search.sequence_logprob(F.col("new"), step, EOS), 6).alias("logprob"),
    )


def sibling_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidate_log(spark, sf_dir).select("problem_id", "iter", "cand_idx", (F.col("score") * -10).alias("logprob"))
    return _rounded(tree.sibling_priors(rows, ["problem_id", "iter"]), "prior").drop("logprob")


def puct_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.chosen_children(commerce_tree(spark, sf_dir), digits=6)


def tree_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    walk = tree.descend(commerce_tree(spark, sf_dir), digits=6)
    return walk.withColumn("path", F.array_join("path", ">"))


def tree_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = commerce_tree(spark, sf_dir).withColumns({"visits": F.lit(0).cast("long"), "value_sum": F.lit(0.0)})
    places = (
        table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
        .join(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(places, "c_custkey")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_discount").alias("value"))
    steps = [F.concat(F.lit(k), F.col(c).cast("string")) for k, c in (("r", "n_regionkey"), ("n", "n_nationkey"), ("c", "c_custkey"), ("o", "o_orderkey"))]
    paths = items.join(orders, "o_orderkey").select(F.col("n_regionkey").alias("tree_id"), F.array(*steps).alias("path"), "value")
    return _rounded(tree.backup(nodes, paths).select("tree_id", "node_id", "visits", "value_sum"), "value_sum", digits=4)


def root_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.root_moves(commerce_tree(spark, sf_dir))


def tree_rounds(spark: SparkSession, sf_dir: str, trees: list | None = None) -> DataFrame:
    problems, generate, tokenise, states = _search_parts(spark, sf_dir)
    grader = grade.linear_grader(linear_weights() * SEARCH_SCALE, 0.0)
    scorer = grade.chat_grader(["problem_id"], tokenise, states, grader)
    return tree.search(
        problems, generate, scorer, k_root=3, k=3, threshold=0.8, max_iters=2, num_simulations=5, max_depth=2, trees=trees
    )


# --- streams


def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = live.stream_table(spark, sf_dir, "events", table(spark, sf_dir, "events").schema)
    done = events.select(
        F.col("event_id").alias("problem_idx"), F.col("event_type").alias("problem"),
        F.col("props").alias("final_answer"), (F.col("value") / 100).alias("final_score"),
    )
    path = scratch_path(spark, "appended")
    live.append_stream(done, f"{path}/results", f"{path}/checkpoint").awaitTermination()
    return _rounded(spark.read.schema(results.RESULT).json(f"{path}/results"), "final_score")


def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    arriving = live.stream_table(spark, sf_dir, "embeddings", table(spark, sf_dir, "embeddings").schema)
    scored = live.score_stream(arriving, grade.linear_grader(linear_weights(), 0.1), "embedding")
    path = scratch_path(spark, "scored")
    live.append_stream(scored.select("vec_id", "logit", "prob"), f"{path}/rows", f"{path}/checkpoint", "parquet").awaitTermination()
    return _rounded(spark.read.schema("vec_id long, logit double, prob double").parquet(f"{path}/rows"), "logit", "prob")


def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = live.stream_table(spark, sf_dir, "events", table(spark, sf_dir, "events").schema)
    path = scratch_path(spark, "summary")
    live.summary_stream(events.select((F.col("value") / 100).alias("final_score")), f"{path}/row", f"{path}/checkpoint").awaitTermination()
    return _rounded(spark.read.parquet(f"{path}/row").select("num_problems", "avg_final_score"), "avg_final_score")


def dense_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate log with gap-free iterations and their candidate counts."""
    from pyspark.sql.window import Window

    from veritrail.operators.skew import lookup_join

    log = candidate_log(spark, sf_dir)
    groups = log.groupBy("problem_id", "iter").agg(F.count(F.lit(1)).cast("int").alias("k"))
    # days of one problem: the calendar bounds this frame
    order = Window.partitionBy("problem_id").orderBy("iter")
    groups = groups.withColumn("dense", (F.row_number().over(order) - 1).cast("int"))
    met = lookup_join(log, groups, ["problem_id", "iter"])
    return met.select("problem_id", F.col("dense").alias("iter"), "cand_idx", "chunk", "score", "eos", "k")


def stream_guided(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = dense_log(spark, sf_dir)
    path = scratch_path(spark, "guided")
    log.write.parquet(f"{path}/log")
    # every batch visits all states, so a longer log comes in larger batches, not in more
    per_trigger = max(4, -(-len(spark.read.parquet(f"{path}/log").inputFiles()) // MOST_BATCHES))
    arriving = spark.readStream.schema(live.CANDIDATE).option("maxFilesPerTrigger", per_trigger).parquet(f"{path}/log")
    live.append_stream(live.guided_stream(arriving), f"{path}/steps", f"{path}/checkpoint", "parquet").awaitTermination()
    return live.latest_steps(spark.read.schema(live.STEP).parquet(f"{path}/steps"))


QUERIES = {
    f.__name__: f
    for f in (
        prefix_quality,
        chat_render_closed, chat_render_generation, chat_render_continue, label_truthiness,
        token_ids, decode_tokens, left_truncate, pad_mask_trim,
        seeded_order, range_order, shard_catalog, catalog_payload_join, early_stop_batches,
        train_val_split, split_by_original,
        prefix_index, prefix_index_capped, prefix_index_whole, prefix_slice, last_state, last_state_whole, last_state_join,
        last_state_gapped, last_state_gapped_join, last_state_batched, masked_mean_pool, masked_mean_pool_join, first_position_pool,
        extraction_catalog, extraction_summary, storage_stats, storage_counts, shard_scan_order,
        vector_widths, rms_normalise, layer_normalise, width_adapter, grade_linear, grade_hidden, grade_residual, grade_stored,
        confusion_metrics, batch_loss, best_epoch, train_step_linear, train_grader, grader_sweep,
        best_candidate, guided_replay, run_summary, guided_rounds, guided_batch, guided_resumed, unguided_baseline, unguided_states,
        sequence_logprob, sibling_priors, puct_choice, tree_descent, tree_backup, root_move, tree_rounds,
        stream_append, stream_score, stream_summary, stream_guided,
    )
}
