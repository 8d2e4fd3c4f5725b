"""State extraction: token ids in, one vector per wanted position out.

An encoder is a causal model: ``encoder(ids)`` takes the ids of one sequence
and returns its ``[L, H]`` states, where state ``t`` depends on tokens up to
``t`` only. A ``BatchEncoder`` takes several sequences at a time, padded to one
width, with a mask of the valid tokens. Encoders run in Arrow batches inside
tasks, and only the positions asked for leave Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from veritrail.functions.vectors import POOL_MIN_WEIGHT
from veritrail.operators.skew import BROADCAST_BYTES, lookup_join, measured_bytes
from veritrail.session import ship_package, written_table

Encoder = Callable[[np.ndarray], np.ndarray]
EncoderFactory = Callable[[], "Encoder | BatchEncoder"]

#: numbers that a task holds before it hands its vectors on
CHUNK_VALUES = 1 << 20
#: distinct tokens and tokens of the sequences that meet their vectors in one group; a sequence counts a few beside its own
BLOCK_VECTORS, BLOCK_TOKENS, ROW_TOKENS = 1 << 18, 1 << 22, 32


class BatchEncoder:
    """A model that is called on padded batches: ``model(ids, mask)`` gives ``[B, W, H]``.

    Sequences of an Arrow batch are sorted by length and taken ``batch_size`` at
    a time, fewer where their padded width would pass ``token_budget``; one
    longer sequence goes alone. Padding stands on the right with mask 0, so it
    never comes before a valid token. States come in the order of the sequences.
    """

    def __init__(
        self, model: Callable[[np.ndarray, np.ndarray], np.ndarray], batch_size: int = 12, token_budget: int = 1 << 16, pad_id: int = 0
    ):
        self.model, self.batch_size, self.token_budget, self.pad_id = model, batch_size, token_budget, pad_id

    def batches(self, lengths: np.ndarray) -> Iterator[np.ndarray]:
        """Numbers of the sequences of each call, the shortest first."""
        taken: list[int] = []
        for k in np.argsort(lengths, kind="stable"):
            # sorted, so the newest is the widest
            if taken and (len(taken) == self.batch_size or (len(taken) + 1) * lengths[k] > self.token_budget):
                yield np.array(taken)
                taken = []
            taken.append(k)
        if taken:
            yield np.array(taken)

    def runs(self, sequences: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """``(number, states)`` of every sequence, batch by batch."""
        lengths = np.array([len(s) for s in sequences], dtype=np.int64)
        for some in self.batches(lengths):
            width = lengths[some].max()
            mask = (np.arange(width) < lengths[some][:, None]).astype(np.int64)
            ids = np.full(mask.shape, self.pad_id, dtype=np.int64)
            ids[mask == 1] = np.concatenate([sequences[k] for k in some])
            states = self.model(ids, mask)
            for row, k in enumerate(some):
                yield int(k), states[row, : lengths[k]]


def _states_of(encoder: Encoder | BatchEncoder, sequences: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """States of every sequence with its number; a batch encoder sorts them by length."""
    if isinstance(encoder, BatchEncoder):
        yield from encoder.runs(sequences)
    else:
        for k, sequence in enumerate(sequences):
            yield k, encoder(sequence)


class TokenVectors:
    """Vectors by token id; ids need not be gap-free. Without ``ids`` row ``i`` belongs to id ``i``."""

    def __init__(self, matrix: np.ndarray, ids: np.ndarray | None = None):
        order = np.arange(len(matrix)) if ids is None else np.argsort(ids, kind="stable")
        self.ids = order if ids is None else np.asarray(ids)[order]
        self.matrix = np.asarray(matrix)[order]
        if (np.diff(self.ids) == 0).any():
            raise ValueError("two vectors for one token id")

    def __len__(self) -> int:
        return len(self.ids)

    @property
    def width(self) -> int:
        return self.matrix.shape[1]

    def take(self, ids: np.ndarray) -> np.ndarray:
        """Vectors of ``ids``; an id without a vector is an error."""
        wanted = np.asarray(ids)
        places = np.searchsorted(self.ids, wanted)
        known = places < len(self.ids)
        known[known] = self.ids[places[known]] == wanted[known]
        if not known.all():
            raise ValueError(f"token id {wanted[~known][0]} has no vector")
        return self.matrix[places].astype(np.float64)


def running_mean_encoder(vectors: TokenVectors) -> Encoder:
    """Default encoder: mean of the token vectors seen so far."""

    def encode(ids: np.ndarray) -> np.ndarray:
        steps = np.arange(1, len(ids) + 1, dtype=np.float64)[:, None]
        return np.cumsum(vectors.take(ids), axis=0) / steps

    return encode


def embedding_matrix(vectors: DataFrame, row: str, vec: str, max_bytes: int = BROADCAST_BYTES) -> TokenVectors | None:
    """The token vectors by id, or None when they are too many to ship."""
    if measured_bytes(vectors.select(row, vec)) > max_bytes:
        return None
    pdf = vectors.select(row, vec).toPandas()
    return TokenVectors(np.stack(pdf[vec].to_numpy()), pdf[row].to_numpy())


def _split(lists: pa.Array) -> list[np.ndarray]:
    """Arrays of a list column over its own memory; null counts as empty."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    return np.split(lists.flatten().to_numpy(zero_copy_only=False), ends[:-1]) if len(ends) else []


def _joined(parts: Sequence[np.ndarray]) -> pa.ListArray:
    """List column of the rows of matrices of one width."""
    flat = np.concatenate(parts)
    ends = np.arange(len(flat) + 1, dtype=np.int64) * flat.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.float64, copy=False).ravel()))


def _numbered_blocks(df: DataFrame, ids: str, vectors: int, tokens: int) -> DataFrame:
    """``df`` with ``_block``: neighbours of a partition share one until they hold so many distinct tokens or tokens.

    Written, since the numbers follow partitions.
    """
    ship_package(df.sparkSession)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, known, held = TaskContext.get().partitionId() << 32, set(), 0
        for batch in batches:
            numbers = []
            for own in _split(batch.column(ids)):
                if len(known) >= vectors or held >= tokens:
                    block, known, held = block + 1, set(), 0
                known.update(own.tolist())
                held += len(own) + ROW_TOKENS
                numbers.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=[*batch.schema.names, "_block"])

    schema = T.StructType([*df.schema.fields, T.StructField("_block", T.LongType())])
    return written_table(df.mapInArrow(number, schema), "blocks")


def with_block_vectors(
    df: DataFrame, ids: str, vectors: DataFrame, row: str, vec: str,
    use: Callable[[pa.RecordBatch, TokenVectors], Iterator[pa.RecordBatch]], schema: T.StructType,
    block_vectors: int = BLOCK_VECTORS, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """``use(sequences, vectors)`` over blocks of sequences, with the vectors of the tokens of each block.

    For vector tables of any size. A vector crosses the shuffle once to a
    block, not once to a token. A task holds one block: its bounds and one
    sequence beyond them, with the vectors.
    """
    stored = _numbered_blocks(df, ids, block_vectors, block_tokens)
    wanted = stored.select(F.col("_block").alias("_for"), F.explode(F.array_distinct(F.col(ids).cast("array<long>"))).alias("_tok")).distinct()
    table = vectors.where(F.col(vec).isNotNull()).select(F.col(row).cast("long").alias("_tok"), F.col(vec).alias("_vec"))
    met = lookup_join(wanted, table, ["_tok"])

    nothing = to_arrow_schema(schema).empty_table()

    def run(sequences: pa.Table, known: pa.Table) -> pa.Table:
        vecs = known.column("_vec").combine_chunks()
        matrix = vecs.flatten().to_numpy(zero_copy_only=False).reshape(len(vecs), -1) if len(vecs) else np.zeros((0, 0))
        held = TokenVectors(matrix, known.column("_tok").to_numpy())
        parts = [out for part in sequences.to_batches() for out in use(part, held)]
        return pa.Table.from_batches(parts) if parts else nothing

    return stored.groupBy("_block").cogroup(met.groupBy("_for")).applyInArrow(run, schema)


def table_encoder(df: DataFrame, vectors: TokenVectors) -> EncoderFactory:
    """Factory over broadcast vectors, so tasks of one executor share them."""
    shared = df.sparkSession.sparkContext.broadcast(vectors)
    return lambda: running_mean_encoder(shared.value)


def _carry(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def _state_schema(df: DataFrame, keys: Sequence[str]) -> T.StructType:
    fields = [T.StructField("prefix_length", T.IntegerType()), T.StructField("vec", T.ArrayType(T.DoubleType()))]
    return T.StructType([*_carry(df, keys), *fields])


def _state_rows(
    batch: pa.RecordBatch, keys: Sequence[str], ids: str, ends: str, encoder: Encoder | BatchEncoder
) -> Iterator[pa.RecordBatch]:
    """Rows ``(keys, prefix_length, vec)`` of the sequences of ``batch``, a bounded number of vectors at a time."""
    lengths, sequences = _split(batch.column(ends)), _split(batch.column(ids))
    wanted = [i for i, w in enumerate(lengths) if len(w)]

    def rows(which: list[int], made: list[np.ndarray]) -> pa.RecordBatch:
        place = pa.array(np.repeat(which, [len(lengths[i]) for i in which]))
        own = [batch.column(name).take(place) for name in keys]
        reached = pa.array(np.concatenate([lengths[i] for i in which]), pa.int32())
        return pa.RecordBatch.from_arrays([*own, reached, _joined(made)], names=[*keys, "prefix_length", "vec"])

    which, made, held = [], [], 0
    for k, states in _states_of(encoder, [sequences[i][: lengths[i].max()] for i in wanted]):
        which.append(wanted[k])
        made.append(states[lengths[wanted[k]] - 1])
        held += made[-1].size
        if held >= CHUNK_VALUES:
            yield rows(which, made)
            which, made, held = [], [], 0
    if which:
        yield rows(which, made)


def states_at(
    df: DataFrame, keys: Sequence[str], ids: str, ends: str, factory: EncoderFactory
) -> DataFrame:
    """One row ``(keys, prefix_length, vec)`` for each length in the array ``ends``."""
    ship_package(df.sparkSession)
    key_list = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = factory()
        for batch in batches:
            yield from _state_rows(batch, key_list, ids, ends, encoder)

    return df.select(*key_list, ids, ends).mapInArrow(run, _state_schema(df, key_list))


def all_states(df: DataFrame, keys: Sequence[str], ids: str, factory: EncoderFactory) -> DataFrame:
    """Long table ``(keys, pos, token_id, vec)``, one row per token."""
    ship_package(df.sparkSession)
    schema = T.StructType(
        [
            *_carry(df, keys),
            T.StructField("pos", T.IntegerType()),
            T.StructField("token_id", T.IntegerType()),
            T.StructField("vec", T.ArrayType(T.DoubleType())),
        ]
    )
    key_list = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = factory()
        for pdf in batches:
            held = [(i, np.asarray(s)) for i, s in enumerate(pdf[ids]) if len(s)]
            parts: list[pd.DataFrame] = []
            values = 0
            for k, states in _states_of(encoder, [s for _, s in held]):
                i, seq = held[k]
                own = {name: [pdf[name].iloc[i]] * len(seq) for name in key_list}
                parts.append(pd.DataFrame({**own, "pos": np.arange(len(seq)), "token_id": seq, "vec": list(states)}))
                values += states.size
                if values >= CHUNK_VALUES:
                    yield pd.concat(parts, ignore_index=True)
                    parts, values = [], 0
            if parts:
                yield pd.concat(parts, ignore_index=True)

    return df.select(*key_list, ids).mapInPandas(run, schema)


def final_state(df: DataFrame, keys: Sequence[str], ids: str, factory: EncoderFactory) -> DataFrame:
    """Only the state after the last token, one row per non-empty sequence."""
    return states_at(_whole(df, ids), keys, ids, "_ends", factory).drop("prefix_length")


def _whole(df: DataFrame, ids: str) -> DataFrame:
    return df.withColumn("_ends", F.filter(F.array(F.size(ids)), lambda n: n > 0))


def running_mean_states(
    df: DataFrame, keys: Sequence[str], ids: str, vectors: DataFrame, row: str, vec: str, ends: str
) -> DataFrame:
    """The default encoder's prefix states by joins, for vector tables of any size."""
    key_list = list(keys)
    needed = F.slice(F.col(ids), F.lit(1), F.coalesce(F.array_max(ends), F.lit(0)))

    def use(sequences: pa.RecordBatch, known: TokenVectors) -> Iterator[pa.RecordBatch]:
        return _state_rows(sequences, key_list, ids, ends, running_mean_encoder(known))

    wanted = df.select(*key_list, needed.alias(ids), ends)
    return with_block_vectors(wanted, ids, vectors, row, vec, use, _state_schema(df, key_list))


class EncoderStates:
    """States from an encoder that runs inside tasks."""

    def __init__(self, factory: EncoderFactory):
        self.factory = factory

    def at(self, df: DataFrame, keys: Sequence[str], ids: str, ends: str, stride_k: int) -> DataFrame:
        return states_at(df, keys, ids, ends, self.factory)

    def final(self, df: DataFrame, keys: Sequence[str], ids: str) -> DataFrame:
        return final_state(df, keys, ids, self.factory)


class TableStates:
    """States of the default encoder over a table of token vectors.

    A table whose measured size fits is shipped to the tasks as a matrix; a
    larger one is met by joins instead. Token ids are the values of ``row`` in
    both, gaps or not, and a token without a vector fails the job in both.
    """

    def __init__(self, vectors: DataFrame, row: str, vec: str, max_bytes: int = BROADCAST_BYTES):
        self.vectors, self.row, self.vec = vectors, row, vec
        matrix = embedding_matrix(vectors, row, vec, max_bytes)
        self.shipped = None if matrix is None else EncoderStates(table_encoder(vectors, matrix))
        self.vocab = vectors.count() if matrix is None else len(matrix)
        if matrix is None and not vectors.groupBy(row).count().where("count > 1").isEmpty():
            raise ValueError("two vectors for one token id")

    def at(self, df: DataFrame, keys: Sequence[str], ids: str, ends: str, stride_k: int) -> DataFrame:
        if self.shipped:
            return self.shipped.at(df, keys, ids, ends, stride_k)
        return running_mean_states(df, keys, ids, self.vectors, self.row, self.vec, ends)

    def final(self, df: DataFrame, keys: Sequence[str], ids: str) -> DataFrame:
        if self.shipped:
            return self.shipped.final(df, keys, ids)
        whole = _whole(df, ids)
        return running_mean_states(whole, keys, ids, self.vectors, self.row, self.vec, "_ends").drop("prefix_length")


States = EncoderStates | TableStates


def _pooled(kept: np.ndarray, table: TokenVectors, width: int) -> np.ndarray:
    return table.take(kept).sum(0) / max(len(kept), POOL_MIN_WEIGHT) if len(kept) else np.zeros(width)


def masked_mean_pool(df: DataFrame, key: str, ids: str, mask: str, token_vectors: TokenVectors) -> DataFrame:
    """Mean of the masked-in token vectors of each sequence, without a shuffle.

    A sequence with nothing masked in gives the zero vector, since its zero sum
    is divided by a floor weight.
    """
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(token_vectors)

    @F.pandas_udf("array<double>")
    def pool(seqs: pd.Series, masks: pd.Series) -> pd.Series:
        table = shared.value
        return pd.Series([_pooled(np.asarray(s)[np.asarray(m) == 1], table, table.width) for s, m in zip(seqs, masks)])

    return df.select(key, pool(ids, mask).alias("vec"))


def masked_mean_pool_join(
    df: DataFrame, key: str, ids: str, mask: str, vectors: DataFrame, row: str, vec: str
) -> DataFrame:
    """The same by joins, for vector tables of any size."""
    kept = F.transform(F.filter(F.arrays_zip(ids, mask), lambda z: z[mask] == 1), lambda z: z[ids])
    width = len(vectors.select(vec).first()[0])

    def use(sequences: pa.RecordBatch, known: TokenVectors) -> Iterator[pa.RecordBatch]:
        if len(sequences):
            pooled = np.stack([_pooled(s, known, width) for s in _split(sequences.column(ids))])
            yield pa.RecordBatch.from_arrays([sequences.column(key), _joined([pooled])], names=[key, "vec"])

    schema = T.StructType([*_carry(df, [key]), T.StructField("vec", T.ArrayType(T.DoubleType()))])
    return with_block_vectors(df.select(key, kept.alias(ids)), ids, vectors, row, vec, use, schema)


def to_half(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Round vectors to half precision, stored as FLOAT."""

    def half(x: Column) -> Column:
        wide = x.cast("double")
        # halves lie 2^(exponent - 10) apart, those near zero 2^-24; the largest is 65504
        step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(wide))), F.lit(-14)) - 10)
        near = F.rint(wide / step) * step
        return F.when(F.abs(wide) < 65520, near).otherwise(F.signum(wide) * float("inf")).cast("float")

    return df.withColumn(vec, F.transform(F.col(vec).cast("array<float>"), half))
