"""The four jobs end to end: corpus, prefix vectors, grader, guided batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.functions.chat import chat_messages, render_chat, system_prompt, without_specials
from veritrail.functions.tokens import Tokeniser, left_truncate
from veritrail.operators import guided
from veritrail.operators.encode import EncoderFactory, States, all_states
from veritrail.operators.grade import Grader, chat_grader
from veritrail.operators.guided import Generator, fan_out
from veritrail.operators.ordering import batch_id, first_batches, sample_id, with_running_start, with_seeded_ordinal
from veritrail.operators.prefixes import STRIDE_K, prefix_lengths
from veritrail.session import cut_lineage, written_table
from veritrail.sources import results as result_io
from veritrail.sources import shards


@dataclass(frozen=True)
class CorpusConfig:
    seed: int = 42
    max_len: int | None = None
    batch_size: int = 12
    shard_size: int = shards.SHARD_SIZE
    end_early: bool = False


def tokenised_corpus(records: DataFrame, id_col: str, tokenise: Tokeniser, config: CorpusConfig) -> DataFrame:
    """Records in seeded order as closed chats, tokenised and cut on the left.

    Gives ``ordinal, id, question, answer, label_correct, length, ids``.
    """
    if config.end_early:
        ordered = first_batches(records, id_col, config.seed, config.batch_size)
    else:
        ordered = with_seeded_ordinal(records, id_col, config.seed)
    messages = chat_messages(system_prompt("corpus"), F.col("question"), F.col("answer"))
    ids = left_truncate(tokenise(render_chat(messages, "closed")), config.max_len)
    return ordered.select(
        "ordinal", F.format_string("ex_%06d", "ordinal").alias("id"), "question", "answer", "label_correct", ids.alias("ids")
    ).withColumn("length", F.size("ids"))


def write_state_shards(
    corpus: DataFrame, path: str, factory: EncoderFactory, metadata: list[str], size: int = shards.SHARD_SIZE
) -> None:
    """All token states in shards, with a catalog that holds no vectors."""
    placed = shards.place_samples(corpus, "ordinal", size)
    states = all_states(placed, ["id", "shard_idx", "local_idx"], "ids", factory)
    # ranges of samples: a large shard is several tasks' work, and files are shards plus tasks at most
    (
        states.withColumn("vec", F.col("vec").cast("array<float>"))
        .repartitionByRange("shard_idx", "local_idx").sortWithinPartitions("shard_idx", "local_idx", "pos")
        .write.partitionBy("shard_idx").parquet(f"{path}/states")
    )
    columns = ["id", "shard_file", "shard_idx", "local_idx", *metadata]
    shards.write_catalog(placed, f"{path}/catalog", columns)


def extract_prefix_vectors(
    corpus: DataFrame,
    path: str,
    states: States,
    stride_k: int = STRIDE_K,
    max_length: int | None = None,
    samples_per_shard: int = shards.SAMPLES_PER_SHARD,
) -> tuple[DataFrame, DataFrame]:
    """State at every prefix end, in shards, with catalog and summary.

    Only the wanted positions leave the encoder; no token state is stored.
    Lengths alone tell how many prefixes a sequence gives, so every sample has
    its number before there is a vector, and vectors are written once.
    """
    # tokenised once; the numbers read its lengths only
    stored = written_table(corpus.select("ordinal", "id", "length", "label_correct", "ids"), "prefix-corpus")
    ends = prefix_lengths(F.col("length"), stride_k, max_length)
    wanted = with_running_start(stored.withColumn("_count", F.size(ends)), "ordinal", "_count", "_start").withColumn("_ends", ends)
    carried = ["_start", "id", "length", "label_correct"]
    placed = states.at(wanted, carried, "ids", "_ends", stride_k).select(
        F.col("id").alias("original_id"), "prefix_length", F.col("length").alias("original_length"),
        F.col("label_correct").cast("float").alias("label"), F.col("vec").cast("array<float>").alias("vec"),
        (F.col("_start") + F.expr(f"(prefix_length - 1) div {stride_k}")).cast("long").alias("ordinal"),
    )
    catalog = shards.write_vector_shards(placed, path, size=samples_per_shard)
    return catalog, shards.extraction_summary(catalog, samples_per_shard)


def guided_batch(
    problems: DataFrame, path: str, generate: Generator, tokenise: Tokeniser, states: States,
    grader: Grader, k: int = 5, threshold: float = 0.95, max_iters: int = 30, max_new: int = 150,
) -> DataFrame:
    """Search a problem table round by round, publish each round's results, give the summary.

    Results and rounds lie under ``path``. A run that was stopped goes on there
    when it is called again with the same settings; so does a finished one,
    with the problems that it has not seen.
    """
    settings = {"k": k, "threshold": threshold, "max_iters": max_iters, "max_new": max_new}
    rounds = result_io.RoundLog(problems.sparkSession, path, settings)
    grade = chat_grader(["problem_id", "cand_idx"], tokenise, states, grader)
    renamed = problems.withColumnRenamed("problem_idx", "problem_id")
    guided.search(renamed, generate, grade, k, threshold, max_iters, max_new=max_new, rounds=rounds)
    return result_io.result_summary(rounds.results(), settings)


def unguided(problems: DataFrame, generate: Generator, tokenise: Tokeniser, max_new: int = 2048) -> DataFrame:
    """One sampled answer per problem, as token sequences for the state pass.

    ``problems`` has ``problem_id, problem, batch_id``. The length to which a
    batch would be padded is kept; the answer text is the whole sequence, the
    prompt included, without special tokens.
    """
    start = problems.withColumns({"round": F.lit("unguided"), "text": F.lit("")})
    prompt = render_chat(chat_messages(system_prompt("search"), F.col("problem")), "generation")
    # drawn once: the widths and the result below both read this draw
    drawn = cut_lineage(generate(fan_out(start, 1, max_new))).withColumn("_prompt", prompt)
    whole = drawn.withColumns({"_asked": tokenise(F.col("_prompt")), "_new": tokenise(F.col("chunk"))})
    # one batch is at most batch_size rows: longest prompt plus longest answer
    widest = whole.groupBy("batch_id").agg(
        (F.max(F.size("_asked")) + F.max(F.size("_new"))).alias("padded_to")
    )
    ids = F.concat("_asked", "_new")
    return whole.join(widest, "batch_id").select(
        "problem_id", "problem", without_specials(F.concat("_prompt", "chunk")).alias("answer_text"), "batch_id",
        ids.alias("ids"), F.size(ids).alias("length"), "padded_to",
    )


def unguided_states(
    problems: DataFrame, path: str, generate: Generator, tokenise: Tokeniser, factory: EncoderFactory,
    batch_size: int = 12, size: int = shards.SHARD_SIZE, max_new: int = 2048, seed: int = 42,
) -> DataFrame:
    """Baseline answers with the states of their whole sequences in shards; gives the catalog.

    ``problems`` is ``(problem_id, problem)``, numbered in seeded order. The
    catalog has no label: it holds the problem, the answer text, the length and
    the width to which its batch was padded, and the sample's place in the shards.
    """
    placed = with_seeded_ordinal(problems, "problem_id", seed).withColumn("batch_id", batch_id("ordinal", batch_size))
    answered = unguided(placed, generate, tokenise, max_new)
    # the states and the catalog both read the answers that were drawn
    corpus = cut_lineage(answered.join(placed.select("problem_id", "ordinal"), "problem_id").withColumn("id", sample_id("ordinal")))
    metadata = ["problem_id", "problem", "answer_text", "length", "padded_to"]
    write_state_shards(corpus, path, factory, metadata, size)
    return problems.sparkSession.read.schema(
        f"id string, shard_file string, shard_idx int, local_idx int, problem_id {dict(problems.dtypes)['problem_id']}, "
        "problem string, answer_text string, length int, padded_to int"
    ).json(f"{path}/catalog")
