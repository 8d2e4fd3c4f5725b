"""SQL twins of the registered queries, written for DuckDB.

They state each result by plain windows, unnested tokens and joins, without the
bucket offsets, hot-key splits, encoders or array trees of the Spark side.
"""

from __future__ import annotations

from veritrail.functions.chat import SYSTEM_PROMPTS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _hash(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 8))::BIGINT"


def _split(text: str = "text") -> str:
    return rf"list_filter(string_split_regex({text}, '\s+'), lambda x: x <> '')"


def _tokens(source: str, key: str, text: str = "text") -> str:
    """``(key, pos, tok)`` with pos from 0."""
    return (
        f"SELECT {key}, unnest(t) AS tok, generate_subscripts(t, 1) - 1 AS pos "
        f"FROM (SELECT {key}, {_split(text)} AS t FROM {source})"
    )


def _prefixes(source: str, stride: int = 100, cap: str = "length") -> str:
    """Every column of ``source`` (with ``length``) and one row per prefix."""
    return (
        f"SELECT s.*, least(i * {stride}, {cap})::INT AS prefix_length FROM {source} s, "
        f"LATERAL (SELECT unnest(generate_series(1, ceil({cap} / {stride}.0)::BIGINT)) AS i)"
    )


CORPUS, SEARCH = _text(SYSTEM_PROMPTS["corpus"]), _text(SYSTEM_PROMPTS["search"])
NL = "chr(10)"


def _turn(role: str, content: str) -> str:
    return f"'<|im_start|>{role}' || {NL} || {content}"


END = f"'<|im_end|>' || {NL}"

DIALOGUE = """
  SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'"""

LABELLED = """
  SELECT d.doc_id, d.source || d.lang AS question, d.text AS answer, d.lang, d.source, l.quality AS label_correct
  FROM documents d JOIN labels l USING (doc_id)"""

LENGTHS = f"SELECT doc_id, len({_split()})::INT AS length FROM documents"

ORDINAL = "row_number() OVER (ORDER BY md5('42:' || {0}), {0}) - 1"

SQL: dict[str, str] = {}

SQL["chat_render_closed"] = f"""
SELECT conv_id, turn, {_turn('system', CORPUS)} || {END} || {_turn('user', 'question')} || {END}
  || {_turn('assistant', 'answer')} || {END} AS rendered FROM ({DIALOGUE})"""

SQL["chat_render_continue"] = f"""
SELECT conv_id, turn, {_turn('system', SEARCH)} || {END} || {_turn('user', 'question')} || {END}
  || {_turn('assistant', 'answer')} AS rendered FROM ({DIALOGUE})"""

SQL["chat_render_generation"] = f"""
SELECT conv_id, turn, {_turn('system', SEARCH)} || {END} || {_turn('user', 'text')} || {END}
  || '<|im_start|>assistant' || {NL} AS rendered FROM conversations WHERE role = 'user'"""

SQL["label_truthiness"] = """
SELECT 'event' AS origin, event_id AS row_id, ((props->>'$.k')::BIGINT <> 0)::INT AS as_number,
  (length(props->>'$.k') > 0)::INT AS as_text, (len(json_keys(props)) > 0)::INT AS as_object, 0 AS as_missing FROM events
UNION ALL
SELECT 'label', doc_id, (quality <> 0)::INT, 1, (toxic = 1)::INT, (quality = 1)::INT FROM labels"""

SQL["token_ids"] = f"""
SELECT item_id, pos::INT AS pos, tok AS token, ({_hash('tok')} % 32000)::INT AS token_id FROM ({_tokens('benchmark', 'item_id')})"""

SQL["decode_tokens"] = f"""
WITH toks AS ({_tokens('benchmark', 'item_id')}),
ids AS (SELECT item_id, pos, {_hash('tok')} % 32000 AS id, tok FROM toks),
vocab AS (SELECT id, min(tok) AS tok FROM ids GROUP BY 1)
SELECT item_id, coalesce(string_agg(v.tok, ' ' ORDER BY pos) FILTER (v.id <> {_hash("'the'")} % 32000), '') AS text
FROM ids JOIN vocab v USING (id) GROUP BY 1"""

SQL["left_truncate"] = f"""
SELECT doc_id, len(t)::INT AS n_tokens, len(kept)::INT AS n_kept, kept[1] AS first_token, md5(array_to_string(kept, ' ')) AS kept_md5
FROM (SELECT doc_id, t, t[greatest(len(t) - 4095, 1):] AS kept FROM (SELECT doc_id, {_split()} AS t FROM documents))"""

SQL["pad_mask_trim"] = f"""
WITH ids AS (SELECT item_id, list_transform({_split()}, lambda x: {_hash('x')} % 32000 + 1) AS ids,
    ({ORDINAL.format('item_id')}) // 12 AS batch_id FROM benchmark),
wide AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS padded_to FROM ids)
SELECT item_id, batch_id, padded_to::INT AS padded_to, len(ids)::INT AS length,
  repeat('0,', (padded_to - len(ids))::INT) || array_to_string(ids, ',') AS padded,
  array_to_string(ids, ',') AS tail, array_to_string(ids, ',') AS masked FROM wide"""

SQL["seeded_order"] = f"""
SELECT doc_id, ordinal, printf('ex_%06d', ordinal) AS id FROM (SELECT doc_id, {ORDINAL.format('doc_id')} AS ordinal FROM documents)"""

SQL["range_order"] = """
SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS ordinal FROM orders"""

SQL["shard_catalog"] = f"""
WITH placed AS (SELECT *, {ORDINAL.format('doc_id')} AS ordinal FROM ({LABELLED}))
SELECT printf('ex_%06d', ordinal) AS id, printf('shard_%04d.pt', ordinal // 50) AS shard_file, (ordinal // 50)::INT AS shard_idx,
  (ordinal % 50)::INT AS local_idx, 'catalog' AS origin, source, question, label_correct, len({_split('answer')})::INT AS length FROM placed"""

SQL["catalog_payload_join"] = f"""
WITH placed AS (SELECT *, {ORDINAL.format('doc_id')} AS ordinal FROM documents)
SELECT printf('ex_%06d', ordinal) AS id, printf('shard_%04d.pt', ordinal // 200) AS shard_file, (ordinal // 200)::INT AS shard_idx,
  (ordinal % 200)::INT AS local_idx, doc_id, 1 AS listed, md5(text) AS text_md5 FROM placed"""

SQL["early_stop_batches"] = f"""
SELECT doc_id, ordinal, ordinal // 12 AS batch_id FROM (SELECT doc_id, {ORDINAL.format('doc_id')} AS ordinal FROM documents)
WHERE ordinal // 12 <= 11"""

SQL["train_val_split"] = f"""
SELECT vec_id, CASE WHEN ordinal < (SELECT floor(count(*) * 0.1::DOUBLE) FROM embeddings) THEN 'val' ELSE 'train' END AS split
FROM (SELECT vec_id, {ORDINAL.format('vec_id')} AS ordinal FROM embeddings)"""

SQL["split_by_original"] = f"""
WITH docs AS (SELECT *, {ORDINAL.format('doc_id')} AS ordinal, count(*) OVER () AS n FROM ({LENGTHS}))
SELECT doc_id, prefix_length, CASE WHEN ordinal < floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split
FROM ({_prefixes('docs')})"""

SQL["prefix_index"] = f"""
SELECT doc_id, doc_id || '_prefix' || prefix_length AS prefix_id, prefix_length, length AS original_length
FROM ({_prefixes(f'({LENGTHS})')})"""

SQL["prefix_index_whole"] = SQL["prefix_index"]

SQL["prefix_index_capped"] = f"""
SELECT doc_id, doc_id || '_prefix' || prefix_length AS prefix_id, prefix_length, length AS original_length
FROM ({_prefixes(f'({LENGTHS})', cap='least(length, 1024)')})"""

SQL["prefix_slice"] = f"""
WITH items AS (SELECT item_id, list_transform({_split()}, lambda x: {_hash('x')} % 32000) AS ids, len({_split()}) AS length FROM benchmark)
SELECT item_id, prefix_length, array_to_string(ids[1:prefix_length], ',') AS ids, prefix_length AS n_mask
FROM ({_prefixes('items', 10, 'length')})"""

SQL["last_state"] = f"""
WITH n AS (SELECT count(*) AS n FROM embeddings),
toks AS ({_tokens('documents', 'doc_id')}),
counted AS (SELECT doc_id, pos // 100 AS stride, {_hash('tok')} % n AS vec_id, count(*) AS c
  FROM toks, n GROUP BY ALL),
dims AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
sums AS (SELECT doc_id, stride, dim, sum(c * x) AS s, sum(c) AS c FROM counted JOIN dims USING (vec_id) GROUP BY ALL)
SELECT doc_id, (sum(c) OVER w)::INT AS prefix_length, dim::INT AS dim, round((sum(s) OVER w) / (sum(c) OVER w), 6) AS value
FROM sums WINDOW w AS (PARTITION BY doc_id, dim ORDER BY stride)"""

SQL["last_state_batched"] = f"""
WITH n AS (SELECT count(*) AS n FROM embeddings), counted AS (SELECT doc_id, {_hash('tok')} % n AS vec_id, count(*) AS c
  FROM ({_tokens('documents', 'doc_id')}), n GROUP BY ALL),
dims AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
SELECT doc_id, sum(c)::INT AS length, dim::INT AS dim, round(sum(c * x) / sum(c), 6) AS value
FROM counted JOIN dims USING (vec_id) GROUP BY doc_id, dim"""

SQL["last_state_whole"] = SQL["last_state"]

SQL["last_state_join"] = SQL["last_state"]
# the same vectors under other token ids
SQL["last_state_gapped"] = SQL["last_state_gapped_join"] = SQL["last_state"]

SQL["masked_mean_pool"] = f"""
WITH n AS (SELECT count(*) AS n FROM embeddings),
toks AS ({_tokens('documents', 'doc_id')}),
counted AS (SELECT doc_id, {_hash('tok')} % n AS vec_id, count(*) AS c FROM toks, n WHERE length(tok) >= 2 GROUP BY ALL),
dims AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
pooled AS (SELECT doc_id, dim, sum(c * x) / greatest(sum(c), 1e-6) AS v FROM counted JOIN dims USING (vec_id) GROUP BY ALL),
every AS (SELECT doc_id, dim FROM documents, (SELECT DISTINCT dim FROM dims))
SELECT doc_id, dim::INT AS dim, round(coalesce(v, 0.0), 6) AS value FROM every LEFT JOIN pooled USING (doc_id, dim)"""

SQL["masked_mean_pool_join"] = SQL["masked_mean_pool"]

SQL["first_position_pool"] = f"""
WITH n AS (SELECT count(*) AS n FROM embeddings),
toks AS ({_tokens('documents', 'doc_id')}),
counts AS (SELECT doc_id, count(*) + 1 AS n_positions FROM toks GROUP BY 1),
firsts AS (SELECT doc_id, {_hash('tok')} % n AS vec_id FROM toks, n WHERE pos = 0),
dims AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
SELECT doc_id, n_positions, n_positions AS n_mask, 0.25::DOUBLE AS class_value, dim::INT AS dim, round(x, 6) AS value
FROM firsts JOIN counts USING (doc_id) JOIN dims USING (vec_id)"""

# the rendered corpus chat, tokenised whole
CORPUS_LENGTHS = f"""
  SELECT doc_id, label_correct, len({_split(f"{_turn('system', CORPUS)} || {END} || {_turn('user', 'question')} || {END} || {_turn('assistant', 'answer')} || {END}")})::INT AS length,
    {ORDINAL.format('doc_id')} AS doc_ordinal FROM ({LABELLED})"""

SQL["extraction_catalog"] = f"""
WITH rows AS ({_prefixes(f'({CORPUS_LENGTHS})')}),
placed AS (SELECT *, row_number() OVER (ORDER BY doc_ordinal, prefix_length) - 1 AS o FROM rows)
SELECT printf('sample_%07d', o) AS sample_id, printf('shard_%04d.pt', o // 500) AS shard_file, (o // 500)::INT AS shard_idx,
  (o % 500)::INT AS local_idx, label_correct::DOUBLE AS label, printf('ex_%06d', doc_ordinal) AS original_id, prefix_length FROM placed"""

SQL["extraction_summary"] = f"""
SELECT count(*) AS total_samples, ceil(count(*) / 500.0)::BIGINT AS total_shards, 500 AS samples_per_shard, 'torch.float16' AS dtype
FROM ({_prefixes(f'({CORPUS_LENGTHS})')})"""

SQL["storage_counts"] = f"""
SELECT count(*) AS n_rows, least(count(*), 500)::BIGINT AS most_rows, ceil(count(*) / 500.0)::BIGINT AS n_files
FROM ({_prefixes(f'({CORPUS_LENGTHS})')})"""

SQL["shard_scan_order"] = """
WITH lines AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS o FROM lineitem),
placed AS (SELECT *, printf('shard_%04d.pt', o // 4) AS shard_file, (o // 4)::INT AS shard_idx, (o % 4)::INT AS local_idx FROM lines)
SELECT shard_file, shard_idx, local_idx, l_orderkey, l_linenumber, row_number() OVER (ORDER BY shard_file, local_idx) - 1 AS scan_pos FROM placed"""

DIMS = "SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings"

SQL["vector_widths"] = """
SELECT count(*) AS n_rows, count(*) FILTER (embedding IS NULL) AS n_missing, min(len(embedding))::INT AS min_width,
  max(len(embedding))::INT AS max_width FROM embeddings"""

SQL["rms_normalise"] = f"""
SELECT vec_id, dim::INT AS dim, round(x / sqrt(avg(x * x) OVER (PARTITION BY vec_id) + 1e-5), 6) AS value FROM ({DIMS})"""

SQL["layer_normalise"] = f"""
SELECT vec_id, dim::INT AS dim, round(c / sqrt(avg(c * c) OVER (PARTITION BY vec_id) + 1e-5), 6) AS value
FROM (SELECT vec_id, dim, x - avg(x) OVER (PARTITION BY vec_id) AS c FROM ({DIMS}))"""

RMS = f"SELECT vec_id, dim, x / sqrt(avg(x * x) OVER (PARTITION BY vec_id) + 1e-5) AS x FROM ({DIMS})"


def _wave(n_in: int, shift: float, scale: float, j: str = "j", i: str = "i") -> str:
    return f"sin({j} * {n_in} + {i} + {shift}) * {scale}::DOUBLE"


SQL["width_adapter"] = f"""
SELECT vec_id, j::INT AS dim, round(sum(x * {_wave(64, 1.0, 0.125, i='dim')}), 6) AS value
FROM ({RMS}), (SELECT unnest(generate_series(0, 15)) AS j) GROUP BY ALL"""


def _graded(logit: str) -> str:
    return f"SELECT vec_id, round(z, 6) AS logit, round(1 / (1 + exp(-z)), 6) AS prob FROM ({logit})"


LINEAR = _graded(f"SELECT vec_id, sum(x * cos(dim)) + 0.1 AS z FROM ({DIMS}) GROUP BY 1")
SQL["grade_linear"] = LINEAR

SQL["grade_hidden"] = _graded(f"""
  SELECT vec_id, sum(h * sin(j + 2.0)) + 0.05 AS z FROM (
    SELECT vec_id, j, greatest(a + cos(j) * 0.1, 0) AS h FROM (
      SELECT vec_id, j, sum(x * {_wave(64, 1.0, 0.25, i='dim')}) AS a
      FROM ({DIMS}), (SELECT unnest(generate_series(0, 7)) AS j) GROUP BY ALL)) GROUP BY 1""")

# erf(x) for |x| < 4 by its power series, each term from the one before
ERF = (
    "2 / sqrt(pi()) * list_sum(list_transform(generate_series(0, 60), "
    "lambda n: CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END * exp((2 * n + 1) * ln(abs(u) + 1e-300) - lgamma(n + 1)) / (2 * n + 1))) * sign(u)"
)

SQL["grade_residual"] = _graded(f"""
  WITH h AS (SELECT vec_id, j AS i, sum(x * {_wave(64, 1.0, 0.25, i='dim')}) AS h
    FROM ({DIMS}), (SELECT unnest(generate_series(0, 3)) AS j) GROUP BY ALL),
  c AS (SELECT vec_id, i, h, h - avg(h) OVER (PARTITION BY vec_id) AS c FROM h),
  n AS (SELECT vec_id, i, h, c / sqrt(avg(c * c) OVER (PARTITION BY vec_id) + 1e-5) AS n FROM c),
  a AS (SELECT vec_id, j, sum(n * {_wave(4, 2.0, 0.5)}) AS a FROM n, (SELECT unnest(generate_series(0, 15)) AS j) GROUP BY ALL),
  g AS (SELECT vec_id, j AS i, 0.5 * a * (1 + {ERF}) AS g FROM (SELECT *, a / sqrt(2) AS u FROM a)),
  f AS (SELECT vec_id, j AS i, sum(g * {_wave(16, 3.0, 0.5)}) AS f FROM g, (SELECT unnest(generate_series(0, 3)) AS j) GROUP BY ALL)
  SELECT vec_id, sum((h + 0.5 * f) * sin(i + 4.0)) + 0.05 AS z FROM n JOIN f USING (vec_id, i) GROUP BY 1""")

SQL["grade_stored"] = SQL["grade_residual"]

PREDICTED = f"""
  SELECT doc_id, lang, label_correct AS label, ({_hash("'p:' || doc_id")} % 1001) / 1000.0::DOUBLE AS prob,
    ({_hash("'z:' || doc_id")} % 2001 - 1000) / 200.0::DOUBLE AS z FROM ({LABELLED})"""


def _rates(by: str, source: str, prob: str = "prob") -> str:
    """Counts and rates by ``by`` of rows with a probability and a label."""
    return f"""
  SELECT *, 2 * precision * recall / (precision + recall + 1e-8) AS f1 FROM (
    SELECT *, (tp + tn) / (tp + tn + fp + fn + 1e-8) AS accuracy, tp / (tp + fp + 1e-8) AS precision, tp / (tp + fn + 1e-8) AS recall FROM (
      SELECT {by}, count(*) FILTER ({prob} > 0.5 AND label = 1) AS tp, count(*) FILTER ({prob} > 0.5 AND label <> 1) AS fp,
        count(*) FILTER ({prob} <= 0.5 AND label <> 1) AS tn, count(*) FILTER ({prob} <= 0.5 AND label = 1) AS fn
      FROM ({source}) GROUP BY ALL))"""


ROUNDED = "round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"

SQL["confusion_metrics"] = f"SELECT lang, tp, fp, tn, fn, {ROUNDED} FROM ({_rates('lang', PREDICTED)})"


def _loss(name: str, order: str) -> str:
    return f"""
  SELECT count(*) AS n_batches, 0::BIGINT AS n_skipped, round(avg(b), 6) AS loss, '{name}' AS pass FROM (
    SELECT avg(greatest(z, 0) - z * label + ln(1 + exp(-abs(z)))) AS b FROM (
      SELECT *, (row_number() OVER (ORDER BY md5('{order}:' || doc_id), doc_id) - 1) // 32 AS batch FROM ({PREDICTED}))
    GROUP BY batch)"""


SQL["batch_loss"] = " UNION ALL ".join(_loss(n, o) for n, o in (("epoch1", "42:1"), ("epoch2", "42:2"), ("eval", "42:eval")))

HISTORY_ROWS = """
  SELECT event_type AS run, (ts::DATE - DATE '2024-01-01' + 1)::INT AS epoch, value / 100 AS prob,
    CASE WHEN (props->>'$.k')::INT >= 50 THEN 1 ELSE 0 END AS label FROM events"""

SQL["best_epoch"] = f"""
WITH history AS (SELECT run, epoch, round(f1, 6) AS f1 FROM ({_rates('run, epoch', HISTORY_ROWS)})),
flagged AS (SELECT *, coalesce(max(f1) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS best_before FROM history),
top AS (SELECT run, max(f1) AS best_f1, max(epoch) AS epochs FROM history GROUP BY 1)
SELECT run, epoch, f1, best_before, f1 > best_before AS is_new_best,
  (SELECT min(h.epoch) FROM history h WHERE h.run = flagged.run AND h.f1 = top.best_f1) AS best_epoch, best_f1,
  round(1e-4 + 9e-4 * (1 + cos(3.141592653589793 * epoch / epochs)) / 2, 9) AS lr
FROM flagged JOIN top USING (run)"""

SQL["prefix_quality"] = f"""
WITH n AS (SELECT count(*) AS n FROM embeddings),
dots AS (SELECT vec_id, sum(x * cos(dim) * 8) AS d FROM ({DIMS}) GROUP BY 1),
toks AS ({_tokens('documents', 'doc_id')}),
strides AS (SELECT doc_id, pos // 100 AS stride, sum(d) AS s, count(*) AS c
  FROM toks, n, dots WHERE vec_id = {_hash('tok')} % n GROUP BY ALL),
states AS (SELECT doc_id, (sum(c) OVER w)::INT AS prefix_length, (sum(s) OVER w) / (sum(c) OVER w) AS z
  FROM strides WINDOW w AS (PARTITION BY doc_id ORDER BY stride)),
judged AS (SELECT prefix_length, round(1 / (1 + exp(-z)), 6) AS prob, quality AS label FROM states JOIN labels USING (doc_id))
SELECT prefix_length, tp, fp, tn, fn, {ROUNDED} FROM ({_rates('prefix_length', 'SELECT * FROM judged')})"""

# one AdamW step from zero moments: the direction is g / (|g| + eps)
SQL["train_step_linear"] = f"""
WITH placed AS (SELECT vec_id, embedding, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y,
    (row_number() OVER (ORDER BY md5('42:1:' || vec_id), vec_id) - 1) // 64 AS batch FROM embeddings),
dims AS (SELECT vec_id, y, batch, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM placed),
logits AS (SELECT vec_id, sum(x * 0.1 * cos(dim)) AS z FROM dims GROUP BY 1),
slopes AS (SELECT vec_id, 1 / (1 + exp(-z)) AS p FROM logits),
inputs AS (SELECT batch, dim, (p - y) * x AS d FROM dims JOIN slopes USING (vec_id)
  UNION ALL SELECT batch, (SELECT max(dim) + 1 FROM dims), p - y FROM placed JOIN slopes USING (vec_id)),
means AS (SELECT batch, dim, avg(d) AS g FROM inputs GROUP BY ALL),
grads AS (SELECT dim, sum(g) / 64 AS g FROM means GROUP BY 1),
clipped AS (SELECT dim, g * least(1, 1 / ((SELECT sqrt(sum(g * g)) FROM grads) + 1e-6)) AS g FROM grads),
start AS (SELECT dim, g, CASE WHEN dim < (SELECT max(dim) FROM grads) THEN 0.1 * cos(dim) ELSE 0 END AS w FROM clipped)
SELECT dim::INT AS idx, round(w * (1 - 0.01 * 0.01) - 0.01 * g / (abs(g) + 1e-8), 6) AS weight FROM start"""


def _training(run: str, epochs: int, rate: float = 1e-3, decay: float = 0.01, accumulation: int = 4, clip: float = 1.0) -> str:
    """Epoch history of a linear grader: one recursion to an update step, state ``(w, m, v)`` with the bias last."""
    after = f"round({0.1 * rate} + {0.9 * rate} * (1 + cos(pi() * epoch / {epochs}.0)) / 2, 9)"
    used = f"({0.1 * rate} + {0.9 * rate} * (1 + cos(pi() * (epoch - 1) / {epochs}.0)) / 2)"

    def f1(tp: str, fp: str, fn: str) -> str:
        p, r = f"(({tp}) / (({tp}) + ({fp}) + 1e-8))", f"(({tp}) / (({tp}) + ({fn}) + 1e-8))"
        return f"round(2 * {p} * {r} / ({p} + {r} + 1e-8), 6)"

    return f"""
WITH RECURSIVE placed AS (SELECT vec_id, list_append(embedding::DOUBLE[], 1.0::DOUBLE) AS x, (label >= 5)::INT AS y,
    row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) - 1 < floor(count(*) OVER () * 0.1::DOUBLE) AS held FROM embeddings),
batched AS (SELECT epoch, x, y, (row_number() OVER (PARTITION BY epoch ORDER BY md5('42:' || epoch || ':' || vec_id), vec_id) - 1) // 64 AS batch
  FROM placed, (SELECT unnest(generate_series(1, {epochs})) AS epoch) WHERE NOT held),
steps AS (SELECT epoch, x, y, dense_rank() OVER (ORDER BY epoch, batch // {accumulation}) AS step,
    count(*) OVER (PARTITION BY epoch, batch) AS size FROM batched),
state AS (
  SELECT 0::BIGINT AS step, 0::BIGINT AS epoch, list_transform(x, lambda e, i: CASE WHEN i < len(x) THEN 0.1 * cos(i - 1) ELSE 0.0 END::DOUBLE) AS w,
    list_transform(x, lambda e: 0.0::DOUBLE) AS m, list_transform(x, lambda e: 0.0::DOUBLE) AS v,
    0.0::DOUBLE AS loss, 0.0::DOUBLE AS tp, 0.0::DOUBLE AS fp, 0.0::DOUBLE AS fn
  FROM (SELECT x FROM placed LIMIT 1)
  UNION ALL
  SELECT step, epoch,
    list_transform(w, lambda e, i: e * (1 - {used} * {decay}) - {used} * m[i] / (1 - 0.9 ** step) / (sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)),
    m, v, loss, tp, fp, fn
  FROM (
    SELECT step, epoch, w, list_transform(m, lambda e, i: 0.9 * e + 0.1 * factor * g[i]) AS m,
      list_transform(v, lambda e, i: 0.999 * e + 0.001 * (factor * g[i]) * (factor * g[i])) AS v, loss, tp, fp, fn
    FROM (
      SELECT *, least(1.0, {clip} / (sqrt(list_sum(list_transform(g, lambda e: e * e))) + 1e-6)) AS factor
      FROM (
        SELECT step, epoch, first(w) AS w, first(m) AS m, first(v) AS v, list(d ORDER BY pos) AS g,
          first(loss) AS loss, first(tp) AS tp, first(fp) AS fp, first(fn) AS fn
        FROM (
          SELECT step, epoch, pos, first(w) AS w, first(m) AS m, first(v) AS v, sum((1 / (1 + exp(-z)) - y) * xi / size / {accumulation}) AS d,
            sum((greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))) / size) AS loss, sum((z > 0 AND y = 1)::INT)::DOUBLE AS tp,
            sum((z > 0 AND y = 0)::INT)::DOUBLE AS fp, sum((z <= 0 AND y = 1)::INT)::DOUBLE AS fn
          FROM (SELECT d.step, d.epoch, d.size, d.y, s.w, s.m, s.v, list_dot_product(s.w, d.x) AS z, unnest(d.x) AS xi, generate_subscripts(d.x, 1) AS pos
            FROM state s JOIN steps d ON d.step = s.step + 1)
          GROUP BY step, epoch, pos)
        GROUP BY step, epoch)))),
train AS (SELECT epoch, arg_max(w, step) AS w, sum(loss) / (SELECT max(batch) + 1 FROM batched) AS loss, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn
  FROM state WHERE step > 0 GROUP BY epoch),
scored AS (SELECT epoch, y, list_dot_product(w, x) AS z, batch FROM train, (SELECT x, y,
    (row_number() OVER (ORDER BY md5('42:eval:' || vec_id), vec_id) - 1) // 64 AS batch FROM placed WHERE held)),
tested AS (SELECT epoch, avg(loss) AS loss, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
    SELECT epoch, batch, avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))) AS loss, sum((z > 0 AND y = 1)::INT)::DOUBLE AS tp,
      sum((z > 0 AND y = 0)::INT)::DOUBLE AS fp, sum((z <= 0 AND y = 1)::INT)::DOUBLE AS fn FROM scored GROUP BY ALL) GROUP BY epoch)
SELECT '{run}' AS run, epoch::INT AS epoch, round(t.loss, 6) AS train_loss, {after} AS lr, round(e.loss, 6) AS val_loss,
  {f1('t.tp', 't.fp', 't.fn')} AS train_f1, {f1('e.tp', 'e.fp', 'e.fn')} AS val_f1
FROM train t JOIN tested e USING (epoch)"""


SQL["train_grader"] = _training("run", 2, rate=0.01, clip=0.05)

_SWEPT = " UNION ALL ".join(
    f"(SELECT * FROM ({_training(*run)}))"
    for run in (
        ("base", 1), ("fast", 1, 1e-2), ("slow", 1, 1e-4), ("no_decay", 1, 1e-3, 0.0), ("strong_decay", 1, 1e-3, 0.1),
        ("short_steps", 1, 1e-3, 0.01, 2), ("long_steps", 1, 1e-3, 0.01, 8),
    )
)
SQL["grader_sweep"] = f"""
WITH runs AS ({_SWEPT})
SELECT *, (SELECT run FROM runs ORDER BY val_loss, run LIMIT 1) AS best_run FROM runs"""

LOG = """
  SELECT user_id AS problem_id, (ts::DATE - DATE '2024-01-01')::INT AS iter, event_id AS cand_idx, event_type || ' ' AS chunk,
    round(least(value / 100, 1.0), 6) AS score, event_type = 'error' AS eos FROM events"""

SQL["best_candidate"] = f"""
WITH log AS ({LOG})
SELECT problem_id, iter, (bool_or(eos) OVER (PARTITION BY problem_id, iter)) AS any_eos, cand_idx, score, eos, chunk
FROM log QUALIFY row_number() OVER (PARTITION BY problem_id, iter ORDER BY score DESC, cand_idx) = 1"""


def _replay(log: str) -> str:
    return f"""
  WITH log AS ({log}),
  best AS (SELECT problem_id, iter, (bool_or(eos) OVER (PARTITION BY problem_id, iter)) AS any_eos, score, chunk
    FROM log QUALIFY row_number() OVER (PARTITION BY problem_id, iter ORDER BY score DESC, cand_idx) = 1),
  judged AS (SELECT *, CASE WHEN score > 0.95 THEN 'threshold' WHEN any_eos THEN 'eos' WHEN trim(chunk) = '' THEN 'blank' END AS reason FROM best),
  walk AS (SELECT * FROM (SELECT *, min(iter) FILTER (reason IS NOT NULL) OVER (PARTITION BY problem_id) AS stop FROM judged)
    WHERE stop IS NULL OR iter <= stop)
  SELECT problem_id, string_agg(chunk, '' ORDER BY iter) AS final_answer, arg_max(score, iter) AS final_score, max(iter) AS last_iter,
    count(*)::INT AS n_rounds, coalesce(max(reason), 'max_iters') AS stop_reason FROM walk GROUP BY 1"""


SQL["guided_replay"] = _replay(LOG)

SQL["run_summary"] = f"""
SELECT count(*) AS num_problems, round(avg(final_score), 6) AS avg_final_score, '{{"threshold":"0.95","max_iters":"30"}}' AS config
FROM ({SQL['guided_replay']})"""

DENSE_LOG = f"SELECT problem_id, (dense_rank() OVER (PARTITION BY problem_id ORDER BY iter) - 1)::INT AS iter, cand_idx, chunk, score, eos FROM ({LOG})"

# the stream says max_iters only where the last allowed iteration closed
SQL["stream_guided"] = f"""
SELECT problem_id, last_iter AS iter, final_answer, final_score, (stop_reason <> 'max_iters' OR last_iter = 29) AS stopped,
  CASE WHEN stop_reason <> 'max_iters' OR last_iter = 29 THEN stop_reason END AS stop_reason FROM ({_replay(DENSE_LOG)})"""

POOL = """
  SELECT chunk, row_number() OVER (ORDER BY md5('pool:' || doc_id || ':' || part), doc_id, part) - 1 AS pool_idx
  FROM (SELECT doc_id, unnest(s) || '. ' AS chunk, generate_subscripts(s, 1) - 1 AS part
    FROM (SELECT doc_id, string_split(text, '. ') AS s FROM documents))"""


def _drawn(round_: str) -> str:
    return f"md5('pool:' || problem_id || ':{round_}:' || cand_idx)"


def _cut(chunk: str, max_new: int | None) -> str:
    return chunk if max_new is None else f"array_to_string(list_slice(string_split({chunk}, ' '), 1, {max_new}), ' ')"


ASKED = f"{_turn('system', SEARCH)} || {END} || {_turn('user', 'problem')} || {END} || {_turn('assistant', chr(39) * 2)}"

SQL["unguided_baseline"] = f"""
WITH pool AS ({POOL}), n AS (SELECT count(*) AS n FROM pool), v AS (SELECT count(*) AS v FROM embeddings),
items AS (SELECT item_id AS problem_id, 0 AS cand_idx, text AS problem, ({ORDINAL.format('item_id')}) // 12 AS batch_id FROM benchmark),
drawn AS (SELECT items.*, {_cut('chunk', 2048)} AS chunk, {ASKED} AS prompt FROM items, n JOIN pool
  ON pool_idx = ('0x' || substr({_drawn('unguided')}, 1, 8))::BIGINT % n),
toks AS (SELECT *, {_split('prompt')} AS a, {_split('chunk')} AS b FROM drawn)
SELECT problem_id, replace(replace(prompt || chunk, '<|im_start|>', ''), '<|im_end|>', '') AS answer_text, batch_id, (len(a) + len(b))::INT AS length,
  (max(len(a)) OVER (PARTITION BY batch_id) + max(len(b)) OVER (PARTITION BY batch_id))::INT AS padded_to,
  array_to_string(list_transform(list_concat(a, b), lambda x: {_hash('x')} % v), ',') AS ids FROM toks, v"""


# the last state of a sequence is the mean of its token vectors
SQL["unguided_states"] = f"""
WITH base AS ({SQL['unguided_baseline']}), placed AS (SELECT base.*, ({ORDINAL.format('problem_id')}) AS ordinal FROM base),
firsts AS (SELECT vec_id, embedding[1]::DOUBLE AS x FROM embeddings),
toks AS (SELECT problem_id, unnest(string_split(ids, ',')) AS tok FROM base),
ends AS (SELECT problem_id, count(*) AS n, avg(x) AS x FROM toks JOIN firsts ON vec_id = tok::BIGINT GROUP BY 1)
SELECT 'ex_' || lpad(ordinal::VARCHAR, 6, '0') AS id, 'shard_' || lpad((ordinal // 20)::VARCHAR, 4, '0') || '.pt' AS shard_file,
  (ordinal // 20)::INT AS shard_idx, (ordinal % 20)::INT AS local_idx, problem_id, length, padded_to, n AS n_states, (n - 1)::INT AS last_pos,
  round(x::FLOAT::DOUBLE, 4) AS last_value FROM placed JOIN ends USING (problem_id)"""


def _guided_rounds(rounds: int = 4, k: int = 5, threshold: float = 0.8, scale: float = 40.0, max_new: int | None = None) -> str:
    """The live search with its rounds written out."""
    parts = [
        f"pool AS ({POOL})", "n AS (SELECT count(*) AS n FROM pool)", "v AS (SELECT count(*) AS v FROM embeddings)",
        f"dots AS (SELECT vec_id, sum(x * cos(dim)) * {scale} AS d FROM ({DIMS}) GROUP BY 1)",
        "active0 AS (SELECT item_id AS problem_id, text AS problem, '' AS text FROM benchmark)",
    ]
    for r in range(rounds):
        draw = _drawn(str(r))
        parts.append(f"""fan{r} AS (SELECT problem_id, problem, text || {_cut('chunk', max_new)} AS answer, {_cut('chunk', max_new)} AS chunk, cand_idx,
          ('0x' || substr({draw}, 9, 8))::BIGINT % 7 = 0 AS eos
          FROM active{r}, (SELECT unnest(generate_series(0, {k - 1})) AS cand_idx), n
          JOIN pool ON pool_idx = ('0x' || substr({draw}, 1, 8))::BIGINT % n)""")
        parts.append(f"chat{r} AS (SELECT problem_id, cand_idx, {ASKED} || answer AS text FROM fan{r})")
        parts.append(f"""score{r} AS (SELECT problem_id, cand_idx, round(1 / (1 + exp(-avg(d))), 6) AS score
          FROM ({_tokens(f'chat{r}', 'problem_id, cand_idx')}), v, dots WHERE vec_id = {_hash('tok')} % v GROUP BY ALL)""")
        parts.append(f"""best{r} AS (SELECT problem_id, problem, answer, score,
          CASE WHEN score > {threshold} THEN 'threshold' WHEN bool_or(eos) OVER (PARTITION BY problem_id) THEN 'eos'
            WHEN trim(chunk) = '' THEN 'blank' {"WHEN true THEN 'max_iters'" if r == rounds - 1 else ''} END AS reason
          FROM fan{r} JOIN score{r} USING (problem_id, cand_idx)
          QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY score DESC, cand_idx) = 1)""")
        parts.append(f"active{r + 1} AS (SELECT problem_id, problem, answer AS text FROM best{r} WHERE reason IS NULL)")
    done = " UNION ALL ".join(
        f"SELECT problem_id, problem, answer AS final_answer, score AS final_score, {r}::INT AS last_iter, reason AS stop_reason FROM best{r} WHERE reason IS NOT NULL"
        for r in range(rounds)
    )
    return f"WITH {', '.join(parts)} {done}"


SQL["guided_rounds"] = _guided_rounds()

SQL["guided_batch"] = f"""
SELECT count(*) AS num_problems, round(avg(final_score), 6) AS avg_final_score, '{{"k":"5","threshold":"0.8","max_iters":"4","max_new":"12"}}' AS config,
  count(*) AS n_written, count(*) AS n_distinct, (max(last_iter) + 1)::INT AS n_rounds FROM ({_guided_rounds(max_new=12)})"""

SQL["guided_resumed"] = _guided_rounds(max_new=12)

def _tree_rounds(
    moves: int = 2, sims: int = 5, k: int = 3, depth: int = 2, threshold: float = 0.8, scale: float = 40.0, max_new: int = 50
) -> str:
    """The live tree search with its moves, simulations and steps down written out."""
    parts = [
        f"pool AS ({POOL})", "n AS (SELECT count(*) AS n FROM pool)", "v AS (SELECT count(*) AS v FROM embeddings)",
        f"dots AS (SELECT vec_id, sum(x * cos(dim)) * {scale} AS d FROM ({DIMS}) GROUP BY 1)",
        "active0 AS (SELECT item_id AS problem_id, text AS problem, '' AS text FROM benchmark)",
    ]

    def add(name: str, sql: str) -> None:
        parts.append(f"{name} AS MATERIALIZED ({sql})")

    def graded(name: str, source: str) -> None:
        add(f"{name}_chat", f"SELECT problem_id, {ASKED} || upto AS text FROM {source}")
        add(name, f"""SELECT problem_id, round(1 / (1 + exp(-avg(d))), 6) AS score
          FROM ({_tokens(f'{name}_chat', 'problem_id')}), v, dots WHERE vec_id = {_hash('tok')} % v GROUP BY ALL""")

    def children(source: str, round_: str, first: str, parent: str, level: str) -> str:
        """Nodes for k draws of every row of ``source``; ``round_`` is an expression."""
        draw = f"md5('pool:' || problem_id || ':' || {round_} || ':' || cand_idx)"
        lp = f"-(('0x' || substr({draw}, 9, 8))::BIGINT % 1000) / 250.0::DOUBLE"
        power = "exp(lp - max(lp) OVER (PARTITION BY problem_id))"
        return f"""SELECT problem_id, {first} + cand_idx AS node_id, {parent} AS parent_id, cand_idx AS ord, {level} AS depth,
          p / sum(p) OVER (PARTITION BY problem_id) AS prior, chunk, eos, false AS terminal, 0 AS visits, 0.0::DOUBLE AS value_sum, NULL::DOUBLE AS grade
          FROM (SELECT *, {power} AS p FROM (SELECT s.*, cand_idx, {_cut('chunk', max_new)} AS chunk, {lp} AS lp,
            ('0x' || substr({draw}, 9, 8))::BIGINT % 7 = 0 AS eos
            FROM {source} s, (SELECT unnest(generate_series(0, {k - 1})) AS cand_idx), n
            JOIN pool ON pool_idx = ('0x' || substr({draw}, 1, 8))::BIGINT % n))"""

    for m in range(moves):
        root = "SELECT problem_id, 0 AS node_id, NULL::BIGINT AS parent_id, 0 AS ord, 0 AS depth, 1.0::DOUBLE AS prior, '' AS chunk, false AS eos, false AS terminal, 0 AS visits, 0.0::DOUBLE AS value_sum, NULL::DOUBLE AS grade"
        add(f"t{m}_0", f"{root} FROM active{m} UNION ALL " + children(f"active{m}", f"'{m}.root'", "1", "0", "1"))
        for i in range(sims):
            tree, walk = f"t{m}_{i}", f"w{m}_{i}_0"
            add(walk, f"SELECT t.problem_id, [0] AS path, text AS upto, {', '.join(f't.{c}' for c in ('node_id', 'depth', 'eos', 'terminal', 'visits', 'grade'))} FROM {tree} t JOIN active{m} USING (problem_id) WHERE node_id = 0")
            for d in range(depth):
                to = f"w{m}_{i}_{d + 1}"
                add(f"c{to}", f"""SELECT t.* FROM {tree} t JOIN {walk} w ON t.problem_id = w.problem_id AND t.parent_id = w.node_id
                  WHERE NOT w.terminal AND NOT w.eos QUALIFY row_number() OVER (PARTITION BY t.problem_id ORDER BY
                    CASE WHEN t.visits > 0 THEN t.value_sum / t.visits ELSE 0 END + 1.0::DOUBLE * t.prior * sqrt(greatest(1, w.visits)) / (1 + t.visits) DESC, t.ord) = 1""")
                add(to, f"""SELECT w.problem_id, CASE WHEN c.node_id IS NULL THEN path ELSE list_append(path, c.node_id) END AS path, upto || coalesce(c.chunk, '') AS upto,
                  {', '.join(f'CASE WHEN c.node_id IS NULL THEN w.{x} ELSE c.{x} END AS {x}' for x in ('node_id', 'depth', 'eos', 'terminal', 'visits', 'grade'))}
                  FROM {walk} w LEFT JOIN c{to} c USING (problem_id)""")
                walk = to
            add(f"l{m}_{i}", f"""SELECT w.*, problem, depth >= {depth} OR eos AS shut, (SELECT count(*) FROM {tree} t WHERE t.problem_id = w.problem_id) AS size,
              EXISTS (SELECT 1 FROM {tree} t WHERE t.problem_id = w.problem_id AND t.parent_id = w.node_id) AS expanded FROM {walk} w JOIN active{m} USING (problem_id)""")
            graded(f"s{m}_{i}", f"(SELECT * FROM l{m}_{i} WHERE grade IS NULL)")
            add(f"g{m}_{i}", f"SELECT l.problem_id, path, node_id, shut, coalesce(grade, score) AS value FROM l{m}_{i} l LEFT JOIN s{m}_{i} USING (problem_id)")
            add(f"k{m}_{i}", children(f"(SELECT problem_id, node_id AS leaf, depth AS level, size FROM l{m}_{i} WHERE NOT shut AND NOT expanded)", f"'{m}.' || leaf", "size", "leaf", "level + 1"))
            add(f"t{m}_{i + 1}", f"""SELECT t.problem_id, t.node_id, parent_id, ord, depth, prior, chunk, eos,
              terminal OR (t.node_id = g.node_id AND g.shut) AS terminal, visits + list_contains(path, t.node_id)::INT AS visits,
              value_sum + CASE WHEN list_contains(path, t.node_id) THEN g.value ELSE 0 END AS value_sum,
              CASE WHEN t.node_id = g.node_id THEN g.value ELSE grade END AS grade
              FROM {tree} t JOIN g{m}_{i} g USING (problem_id) UNION ALL SELECT * FROM k{m}_{i}""")
        add(f"m{m}", f"""SELECT problem_id, problem, text || chunk AS upto, chunk, eos FROM t{m}_{sims} JOIN active{m} USING (problem_id)
          WHERE parent_id = 0 QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY visits DESC, ord) = 1""")
        graded(f"e{m}", f"m{m}")
        add(f"best{m}", f"""SELECT problem_id, problem, upto, score, CASE WHEN score > {threshold} THEN 'threshold' WHEN eos THEN 'eos' WHEN trim(chunk) = '' THEN 'blank'
          {"WHEN true THEN 'max_iters'" if m == moves - 1 else ''} END AS reason FROM m{m} JOIN e{m} USING (problem_id)""")
        add(f"active{m + 1}", f"SELECT problem_id, problem, upto AS text FROM best{m} WHERE reason IS NULL")
    done = " UNION ALL ".join(
        f"SELECT problem_id, problem, upto AS final_answer, score AS final_score, {m}::INT AS last_iter, reason AS stop_reason FROM best{m} WHERE reason IS NOT NULL"
        for m in range(moves)
    )
    return f"WITH {', '.join(parts)} {done}"


SQL["tree_rounds"] = _tree_rounds()

SQL["sequence_logprob"] = f"""
WITH toks AS (SELECT item_id, pos - 3 AS t, {_hash('tok')} % 16 AS id FROM ({_tokens('benchmark', 'item_id')}) WHERE pos >= 3),
ends AS (SELECT item_id, min(t) FILTER (id = 3) AS stop, count(*) AS n FROM toks GROUP BY 1)
SELECT item_id, n::INT AS n_new, stop IS NOT NULL AS eos,
  round(sum(-({_hash("'lp:' || item_id || ':' || t")} % 1000) / 100.0::DOUBLE) FILTER (stop IS NULL OR t <= stop), 6) AS logprob
FROM toks JOIN ends USING (item_id) GROUP BY ALL"""

SQL["sibling_priors"] = f"""
SELECT problem_id, iter, cand_idx, round(e / sum(e) OVER (PARTITION BY problem_id, iter), 6) AS prior FROM (
  SELECT problem_id, iter, cand_idx, exp(score * -10 - max(score * -10) OVER (PARTITION BY problem_id, iter)) AS e FROM ({LOG}))"""

TREE = """
orderstat AS (SELECT n_regionkey AS r, n_nationkey AS n, c_custkey AS c, o_orderkey AS o, o_orderstatus = 'F' AS eos,
    count(l_orderkey) AS visits, coalesce(sum(l_discount), 0.0) AS value_sum
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
custstat AS (SELECT n_regionkey AS r, n_nationkey AS n, c_custkey AS c, coalesce(sum(visits), 0)::BIGINT AS visits, coalesce(sum(value_sum), 0.0) AS value_sum
  FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orderstat ON c = c_custkey GROUP BY ALL),
natstat AS (SELECT n_regionkey AS r, n_nationkey AS n, coalesce(sum(visits), 0)::BIGINT AS visits, coalesce(sum(value_sum), 0.0) AS value_sum
  FROM nation LEFT JOIN custstat ON n = n_nationkey GROUP BY ALL),
nodes AS (
  SELECT r_regionkey AS tree_id, 'r' || r_regionkey AS node_id, NULL::VARCHAR AS parent_id, r_regionkey::BIGINT AS child_ord, 0 AS depth, false AS eos,
    coalesce(sum(visits), 0)::BIGINT AS visits, coalesce(sum(value_sum), 0.0) AS value_sum FROM region LEFT JOIN natstat ON r = r_regionkey GROUP BY ALL
  UNION ALL SELECT r, 'n' || n, 'r' || r, n, 1, false, visits, value_sum FROM natstat
  UNION ALL SELECT r, 'c' || c, 'n' || n, c, 2, false, visits, value_sum FROM custstat
  UNION ALL SELECT r, 'o' || o, 'c' || c, o, 3, eos, visits, value_sum FROM orderstat),
scored AS (SELECT k.tree_id, k.parent_id, k.node_id, k.child_ord, k.depth, k.eos, k.visits,
    round(CASE WHEN k.visits > 0 THEN k.value_sum / k.visits ELSE 0 END
      + 1.0 / count(*) OVER (PARTITION BY k.tree_id, k.parent_id) * sqrt(greatest(p.visits, 1)) / (k.visits + 1), 6) AS puct
  FROM nodes k JOIN nodes p ON p.node_id = k.parent_id AND p.tree_id = k.tree_id),
chosen AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY tree_id, parent_id ORDER BY puct DESC, child_ord) = 1)"""

SQL["puct_choice"] = f"WITH {TREE} SELECT tree_id, parent_id, node_id AS child_id, puct FROM chosen"

SQL["tree_descent"] = f"""
WITH {TREE}
SELECT a.tree_id, concat_ws('>', a.parent_id, a.node_id, b.node_id, c.node_id) AS path,
  coalesce(c.node_id, b.node_id, a.node_id) AS leaf_id, coalesce(c.depth, b.depth, a.depth)::INT AS leaf_depth
FROM chosen a LEFT JOIN chosen b ON b.parent_id = a.node_id AND NOT a.eos LEFT JOIN chosen c ON c.parent_id = b.node_id AND NOT b.eos
WHERE a.parent_id LIKE 'r%'"""

SQL["tree_backup"] = f"WITH {TREE} SELECT tree_id, node_id, visits, round(value_sum, 4) AS value_sum FROM nodes"

SQL["root_move"] = f"""
WITH {TREE} SELECT tree_id, node_id, visits, eos FROM scored WHERE parent_id LIKE 'r%'
QUALIFY row_number() OVER (PARTITION BY tree_id ORDER BY visits DESC, child_ord) = 1"""

SQL["stream_append"] = """
SELECT event_id AS problem_idx, event_type AS problem, props AS final_answer, round(value / 100, 6) AS final_score FROM events"""

SQL["stream_score"] = LINEAR

SQL["stream_summary"] = "SELECT count(*) AS num_problems, round(avg(value / 100), 6) AS avg_final_score FROM events"

ORACLE_SQL = SQL
