"""Shards of samples and of prefix vectors, with their catalogs and summaries.

A shard is a partition folder ``shard_idx=N`` of a Parquet table. The catalog
is a separate narrow table, so it can be read without the payload.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions.vectors import width_check
from veritrail.operators.encode import to_half
from veritrail.operators.ordering import sample_id, shard_placement

SHARD_SIZE = 2000
SAMPLES_PER_SHARD = 10000


def place_samples(df: DataFrame, ordinal: str, size: int = SHARD_SIZE) -> DataFrame:
    """Add ``id, shard_file, shard_idx, local_idx``; own columns of those names win."""
    placed = {"id": sample_id(ordinal)}
    shard, local, name = shard_placement(ordinal, size)
    placed.update(shard_idx=shard, local_idx=local, shard_file=name)
    return df.select(*[c.alias(n) for n, c in placed.items() if n not in df.columns], "*")


def override(metadata: DataFrame, base: dict[str, Column]) -> DataFrame:
    """Merge base columns with metadata columns; the metadata wins on a clash."""
    return metadata.select(*[c.alias(n) for n, c in base.items() if n not in metadata.columns], "*")


def merge_maps(left: Column, right: Column) -> Column:
    """Union of two maps in which entries of ``right`` win."""
    kept = F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(kept, right)


def write_shards(placed: DataFrame, path: str, size: int = SHARD_SIZE) -> None:
    """One file per shard of ``size`` rows; an empty table writes no shard."""
    (
        placed.repartition("shard_idx")
        .sortWithinPartitions("shard_idx", "local_idx")
        .write.option("maxRecordsPerFile", size)
        .partitionBy("shard_idx")
        .parquet(path)
    )


def write_catalog(placed: DataFrame, path: str, columns: Sequence[str], ordinal: str = "ordinal") -> None:
    """JSON lines in id order, spread over as many sorted files as Spark wants."""
    placed.repartitionByRange(ordinal).sortWithinPartitions(ordinal).select(*columns).write.json(path)


def write_vector_shards(df: DataFrame, path: str, ordinal: str = "ordinal", size: int = SAMPLES_PER_SHARD) -> DataFrame:
    """Half-precision vectors and float labels in shards, plus the catalog.

    ``df`` holds ``original_id, prefix_length, original_length, label, vec`` and
    the ordinal. Returns the catalog read back.
    """
    spark = df.sparkSession
    shard, local, name = shard_placement(ordinal, size)
    placed = to_half(df).select(
        sample_id(ordinal, "sample_", 7).alias("sample_id"), shard, local, name,
        "original_id", "prefix_length", "original_length", F.col("label").cast("float").alias("label"), "vec", ordinal,
    )
    write_shards(placed, f"{path}/vectors", size)
    # the catalog is derived from what was written, so vectors are made once
    columns = ["sample_id", "shard_file", "shard_idx", "local_idx", "label", "original_id", "prefix_length"]
    write_catalog(spark.read.parquet(f"{path}/vectors"), f"{path}/catalog", columns, ordinal)
    return spark.read.schema(
        "sample_id string, shard_file string, shard_idx int, local_idx int, label float, "
        "original_id string, prefix_length int"
    ).json(f"{path}/catalog")


def read_vector_shards(spark: SparkSession, path: str) -> DataFrame:
    """All vectors of all shards; fails when rows lack a vector or widths differ."""
    table = spark.read.parquet(f"{path}/vectors")
    facts = width_check(table).first()
    if facts["n_missing"] or facts["min_width"] != facts["max_width"]:
        raise ValueError(f"uneven vectors in {path}: {facts.asDict()}")
    return table


def payload_of(catalog: DataFrame, payload: DataFrame) -> DataFrame:
    """Catalog rows with their payload, by shard and place in the shard."""
    return catalog.join(payload, ["shard_idx", "local_idx"])


def shard_files(catalog: DataFrame) -> DataFrame:
    return catalog.select("shard_file").distinct()


def extraction_summary(catalog: DataFrame, samples_per_shard: int, dtype: str = "torch.float16") -> DataFrame:
    return catalog.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.countDistinct("shard_idx").alias("total_shards"),
        F.lit(samples_per_shard).alias("samples_per_shard"),
        F.lit(dtype).alias("dtype"),
    )


def storage_stats(spark: SparkSession, path: str) -> DataFrame:
    """Bytes on disk, GiB, number of files and mean MiB per file of a table.

    A listing of its files; none is opened.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    files = listed.select(F.col("length").alias("file_size"))
    total = F.sum("file_size")
    return files.agg(
        total.alias("total_bytes"),
        (total / F.lit(1024.0**3)).alias("total_gib"),
        F.count(F.lit(1)).alias("n_files"),
        (total / F.count(F.lit(1)) / F.lit(1024.0**2)).alias("mean_file_mib"),
    )


def storage_counts(spark: SparkSession, path: str) -> DataFrame:
    """Files, rows and rows of the fullest file of a table; rows come from the files' footers."""
    files = storage_stats(spark, path).select("n_files")
    counted = spark.read.parquet(path).groupBy("_metadata.file_path").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.max("n"), F.lit(0)).alias("most_rows"))
    # one row on either side
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(files.withColumn("_one", F.lit(1))), "_one").drop("_one")
