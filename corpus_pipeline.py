"""Training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

1. ``language_id`` drops documents whose language is rejected (no letter, or below the calibrated threshold).
2. ``simhash_dedup`` keeps one document of each near-duplicate group.
3. ``secret_scan`` masks credentials in the texts; no document goes.
4. ``mix_sources`` puts the documents in the order of a weighted mix, written in ranges of it; no document goes.
5. ``byte_bpe`` encodes each whole text, decodes it again and returns counts and digests, and with ``mix_place``
   the document's place in the mix, 0..n-1.

Stages 1 to 4 return the columns of ``documents``, whatever further ones there are and however they are named; the mix is handed on by the order of rows and files, from which the
last stage reads the place, as the files may be read in any order.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.llm import bpe, langid, pfair, secret_scan, simhash
from veritrail.llm.queries import public_codec
from veritrail.session import scratch_path


def carried(docs: DataFrame, *names: str) -> DataFrame:
    """The columns ``names`` of ``docs`` and ``row``, all its columns in one, so that no name of theirs meets an operator's."""
    return docs.select(*names, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known = langid.predict(carried(docs, "text"), langid.train(docs))
    return known.where(~F.col("rejected")).select("row.*")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pfair.interleaved(pfair.mix(carried(docs, "doc_id", "source"), pfair.tempered_weights(docs))).select("row.*")


def with_place(docs: DataFrame, out: str) -> DataFrame:
    """``docs`` with each row's place in the table as it was written: by part number, then by row within the file.

    Null where ``docs`` is not read from files, whose rows have no order. A column named ``out`` is replaced.
    """
    own = [c for c in docs.columns if c.lower() != out.lower()]
    kept = carried(docs.select(*own))
    try:
        at = carried(docs.select(*own), "_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return kept.select("row.*", F.lit(None).cast("bigint").alias(out))
    # one row to a file
    files = at.groupBy("file_name").agg(F.count(F.lit(1)).alias("n"))
    part = F.regexp_extract("file_name", r"part-(\d+)", 1).try_cast("bigint")
    before = Window.orderBy(part, "file_name").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file_name", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return at.join(F.broadcast(starts), "file_name").select("row.*", (F.col("start") + F.col("row_index")).alias(out))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = with_place(docs.select("doc_id", "text"), "mix_place")
    return bpe.encode_digests(placed, public_codec(), carry=("mix_place",))


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("secret_scan", mask_secrets),
    ("mix_sources", mix_sources),
    ("byte_bpe", byte_bpe),
]

# a trained model, a 64-bit hash and merges by rank: not expressible in SQL; tests hold the run against plain loops
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
