"""BPE over a table of distinct words (operator 11).

Spark splits the texts into words, counts them and encodes each distinct word
once. The ids come back to the texts by position: the frequent words, as many
as a measured bound admits, by a lookup that is shipped to the tasks, all others
by joins on the word and the row. Decoding joins ids to the pieces of the
vocabulary, whose size is fixed.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.common import python_ready
from veritrail.llm.space_words import frequent, words_of
from veritrail.session import drop_scratch, scratch_path, spread, written_table

#: words and ids that are shipped to the tasks at most
HOT_BYTES = 128 * 1024 * 1024
BATCH_BYTES = 16 * 1024 * 1024
#: pre-tokens whose ids a task keeps while it encodes the distinct words
KEPT = 200_000


def byte_letters() -> dict[str, int]:
    """The printable letter by which byte-level vocabularies write each byte."""
    # fixed values: bytes that stand for themselves; the others take the code points from 256 on, in order
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(moved)}


class ByteLevelVocabulary:
    """Ids, merges and added tokens of a tokenizer file in JSON."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if model["type"] != "BPE" or not plain or not byte_level or spec.get("normalizer") or spec.get("post_processor"):
            raise ValueError("not a plain byte-level BPE file")
        if any(t[flag] for t in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take white space or whole words only are not supported")
        self.text, self.vocab = text, model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: pair of ids -> rank, and rank -> id of the merged piece
        self.rank = {(self.vocab[a] << 32) | self.vocab[b]: r for r, (a, b) in enumerate(merges)}
        self.made = [self.vocab[a + b] for a, b in merges]

    def pieces(self) -> dict[int, bytes]:
        """Bytes of every id; an added token stands for its own text."""
        letters = byte_letters()
        own = {i: bytes(letters[c] for c in token) for token, i in self.vocab.items()}
        return own | {i: token.encode() for token, i in self.added.items()}


class WordEncoder:
    """Ids of single words, for the tasks that fill the table of distinct words."""

    def __init__(self, vocabulary: ByteLevelVocabulary):
        from tokenizers import Tokenizer

        self.vocabulary = vocabulary
        # the file's own pre-tokenizer: the same character classes as in the library
        self.cut = Tokenizer.from_str(vocabulary.text).pre_tokenizer.pre_tokenize_str
        longest = sorted(vocabulary.added, key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, longest))) if longest else None
        self.kept: dict[str, list[int]] = {}

    def merge(self, token: str) -> list[int]:
        """Merge one pre-token: always the pair of lowest rank, the leftmost of equals."""
        rank, made = self.vocabulary.rank.get, self.vocabulary.made
        ids: list[int | None] = [self.vocabulary.vocab[c] for c in token]
        n = len(ids)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank((ids[i] << 32) | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = right[i]
            # stale unless both sides are still what they were when the pair was seen
            if ids[i] is None or j >= n or rank((ids[i] << 32) | ids[j]) != r:
                continue
            ids[i], ids[j], right[i] = made[r], None, right[j]
            if right[i] < n:
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < n and (again := rank((ids[a] << 32) | ids[b])) is not None:
                    heappush(heap, (again, a))
        return [x for x in ids if x is not None]

    def plain(self, text: str) -> list[int]:
        out: list[int] = []
        for token, _ in self.cut(text):
            found = self.kept.get(token)
            if found is None:
                found = self.merge(token)
                if len(self.kept) >= KEPT:
                    self.kept.clear()
                self.kept[token] = found
            out += found
        return out

    def encode(self, word: str) -> list[int]:
        """Ids of a word; added tokens inside it are found first."""
        if not self.added or not self.added.search(word):
            return self.plain(word)
        out, start = [], 0
        for hit in self.added.finditer(word):
            out += [*self.plain(word[start : hit.start()]), self.vocabulary.added[hit.group()]]
            start = hit.end()
        return out + self.plain(word[start:])


def vocabulary_of(path: str) -> ByteLevelVocabulary:
    with open(path, encoding="utf-8") as file:
        return ByteLevelVocabulary(file.read())


def ready(spark: SparkSession) -> None:
    """Batches bounded by bytes: texts differ in length by orders of magnitude."""
    python_ready(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n``: every distinct word of the corpus with its occurrences."""
    words = docs.select(F.explode(words_of(F.coalesce(F.col(text), F.lit("")))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def encode_words(words: DataFrame, vocabulary: ByteLevelVocabulary, carry: str = "") -> DataFrame:
    """``word`` and ``ids`` of each row, and the columns that ``carry`` declares.

    Rows in the order of their words cost one encoding to a run of equal words.
    """
    shared = words.sparkSession.sparkContext.broadcast(vocabulary)
    names = [c.split()[0] for c in carry.split(",")] if carry else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = WordEncoder(shared.value)
        last, ids = None, []
        for pdf in batches:
            out = []
            for word in pdf["word"]:
                if word != last:
                    last, ids = word, encoder.encode(word)
                out.append(ids)
            yield pd.DataFrame({**{c: pdf[c] for c in names}, "word": pdf["word"], "ids": out})

    schema = ", ".join([*([carry] if carry else []), "word string, ids array<int>"])
    return words.select(*names, "word").mapInPandas(run, schema)


class HotWords:
    """The shipped part of the word table: words with their ids in one flat array."""

    def __init__(self, table: pa.Table):
        table = table.cast(pa.schema([("word", pa.string()), ("ids", pa.list_(pa.int32()))])).combine_chunks()
        self.words = table["word"].combine_chunks()
        lists = table["ids"].combine_chunks()
        self.flat = lists.flatten().to_numpy(zero_copy_only=False)
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        # the last place is that of a word which is not here
        self.starts = np.append(np.append(0, np.cumsum(sizes)), sizes.sum()).astype(np.int32)

    def places(self, words: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(words, self.words), len(self.words)).to_numpy(zero_copy_only=False)

    def ids_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at ``places`` in a row, and how many each word gave."""
        starts = self.starts[places].astype(np.int64)
        lengths = self.starts[places + 1] - starts
        return gather(self.flat, starts, lengths), lengths


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Runs of ``flat`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1])]


def lists_of(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)


NUMBERED = "doc_id bigint, key binary, numbers binary, holes array<string>"


def split_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, key, words``. ``key`` is a digest of id and text: rows that share it have the same ids, however often they are read."""
    whole = F.coalesce(F.col(text), F.lit(""))
    key = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), whole)))
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), key.alias("key"), words_of(whole).alias("words"))


def located(table: HotWords, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Places of the words of some rows in the table, words to a row, the words outside the table, and those to a row."""
    sizes = np.diff(lists.offsets.to_numpy())
    words = lists.flatten()
    places = table.places(words)
    lost = np.flatnonzero(places == len(table.words))
    row_of = np.repeat(np.arange(len(sizes)), sizes)[lost]
    return places, sizes, words.take(pa.array(lost)), np.bincount(row_of, minlength=len(sizes))


def numbered(split: DataFrame, shared) -> DataFrame:
    """``doc_id, key, numbers, holes``: each word's place in the shipped table in three bytes, and the words outside it, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, sizes, others, per_row = located(shared.value, batch.column("words"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), packed(places, sizes), lists_of(others, per_row)], ["doc_id", "key", "numbers", "holes"]
            )

    return split.mapInArrow(run, NUMBERED)


def in_place(split: DataFrame, shared, single, finish: Finish) -> DataFrame:
    """Results of rows whose words are in the shipped table or occur once: those are encoded here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, encoder = shared.value, WordEncoder(single.value)
        for batch in batches:
            places, sizes, others, per_row = located(table, batch.column("words"))
            spelled = others.to_pylist()
            ends, stops = np.append(0, np.cumsum(sizes)), np.append(0, np.cumsum(per_row))
            ids = [
                resolve(table, places[ends[k] : ends[k + 1]], [np.array(encoder.encode(w), dtype=np.int32) for w in spelled[stops[k] : stops[k + 1]]])
                for k in range(len(sizes))
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *finish.columns(ids)], finish.names())

    return split.mapInArrow(run, finish.schema)


def patched(met: DataFrame, shared, finish: Finish) -> DataFrame:
    """Results of rows ``doc_id, numbers, patches``, in which the patches are the ids of the words outside the table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            others = ([] if own is None else [np.asarray(p["ids"], dtype=np.int32) for p in own] for own in pdf["patches"])
            ids = [resolve(shared.value, unpacked(n), o) for n, o in zip(pdf["numbers"], others, strict=True)]
            arrays = [pa.array(pdf["doc_id"], pa.int64(), from_pandas=True), *finish.columns(ids)]
            yield pa.table(arrays, finish.names()).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

    return met.select("doc_id", "numbers", "patches").mapInPandas(run, finish.schema)


class IdLists:
    """What is made of the ids of a row: the ids."""

    schema = "doc_id bigint, ids array<int>"

    def names(self) -> list[str]:
        return [c.split()[0] for c in self.schema.split(", ")]

    def columns(self, ids: list[np.ndarray]) -> list[pa.Array]:
        return [lists_of(pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *ids]), pa.int32()), np.array([len(x) for x in ids], dtype=np.int64))]


class Digests(IdLists):
    """Counts and digests of the ids and of the text that they give back."""

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def __init__(self, pieces):
        self.pieces = pieces

    def columns(self, ids: list[np.ndarray]) -> list[pa.Array]:
        texts = [b.decode("utf-8", "replace") for b in self.pieces.value.decode(ids)]
        return [
            pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
        ]


Finish = IdLists | Digests


def packed(places: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The numbers of each row as binary, three bytes to a number."""
    raw = np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])
    offsets = np.append(0, np.cumsum(sizes, dtype=np.int64) * 3).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def unpacked(numbers: bytes) -> np.ndarray:
    wide = np.zeros((len(numbers) // 3, 4), dtype=np.uint8)
    wide[:, :3] = np.frombuffer(numbers, dtype=np.uint8).reshape(-1, 3)
    return wide.view("<u4").ravel().astype(np.int64)


def resolve(table: HotWords, places: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Ids of a row: those of the shipped words, and at the places of the other words theirs, in order."""
    ids, lengths = table.ids_of(places)
    if not others:
        return ids
    at = (np.cumsum(lengths) - lengths)[places == len(table.words)]
    return np.insert(ids, np.repeat(at, [len(x) for x in others]), np.concatenate(others))


def encode(
    docs: DataFrame, vocabulary: ByteLevelVocabulary, doc_id: str = "doc_id", text: str = "text", hot_bytes: int = HOT_BYTES
) -> DataFrame:
    """``doc_id, ids`` of every row: the ids of its whole text as ``array<int>``.

    A null or empty text has no ids; ids may be null or repeated. Other columns,
    whatever their names, are not read. Very long texts are lists of words like
    others; white space between words is part of them, so a text without single
    spaces is one word.

    Words outside the shipped table that occur once are encoded where they
    stand. Where the table leaves out repeated words as well, all words outside
    it meet by a shuffle on the word, in which each distinct one is encoded
    once, and go to their texts by one on ``key`` and their order in the text.
    They are rare ones, so no word is a hot key.
    """
    return _encoded(docs, vocabulary, doc_id, text, hot_bytes, IdLists())


def _encoded(docs: DataFrame, vocabulary: ByteLevelVocabulary, doc_id: str, text: str, hot_bytes: int, finish: Finish) -> DataFrame:
    spark = docs.sparkSession
    ready(spark)
    path = scratch_path(spark, "bpe-words")
    counts = written_table(word_counts(docs, text), "bpe-words", path=path)
    # a word has at most as many ids as bytes; most have a third
    chosen, held, beyond = frequent(counts, "n", F.octet_length("word") * 3 + 16, hot_bytes)
    words = counts.where(chosen)
    hot = HotWords(encode_words(spread(words), vocabulary).toArrow() if held else pa.table({"word": [], "ids": []}))
    drop_scratch(spark, path)
    shared = spark.sparkContext.broadcast(hot)
    single = spark.sparkContext.broadcast(vocabulary)
    split = split_rows(docs, doc_id, text)
    # a count of one binary digit is one
    if beyond <= 1:
        return in_place(split.select("doc_id", "words"), shared, single, finish)
    rows = numbered(split, shared)
    holes = rows.select("key", F.posexplode("holes").alias("k", "word"))
    found = encode_words(holes.repartition("word").sortWithinPartitions("word"), vocabulary, "key binary, k int")
    # rows of one key have the same holes
    patches = found.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("k", "ids"))).alias("patches"))
    return patched(rows.select("doc_id", "key", "numbers").join(patches, "key", "left"), shared, finish)


class Pieces:
    """The id-to-piece table, with its bytes in one flat array."""

    def __init__(self, pieces: dict[int, bytes]):
        ids = sorted(pieces)
        self.flat = np.frombuffer(b"".join(pieces[i] for i in ids), dtype=np.uint8)
        lengths = np.array([len(pieces[i]) for i in ids], dtype=np.int64)
        # without gaps the join finds its rows by arithmetic
        index = pd.RangeIndex(len(ids), name="id") if ids == list(range(len(ids))) else pd.Index(ids, name="id")
        self.table = pd.DataFrame({"start": np.cumsum(lengths) - lengths, "length": lengths}, index=index)

    def decode(self, lists: list[np.ndarray]) -> list[bytes]:
        """Bytes of each list of ids: all ids of the batch meet the table in one join, in their order."""
        if not lists:
            return []
        ids = pd.DataFrame({"id": np.concatenate(lists)})
        met = ids.join(self.table, on="id")
        if met["start"].isna().any():
            raise ValueError(f"no piece for id {met['id'][met['start'].isna()].iloc[0]}")
        lengths = met["length"].to_numpy(dtype=np.int64)
        raw = gather(self.flat, met["start"].to_numpy(dtype=np.int64), lengths).tobytes()
        ends = np.append(0, np.cumsum(lengths))[np.cumsum([0, *map(len, lists)])]
        return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _arrays(lists: pd.Series) -> list[np.ndarray]:
    none = np.zeros(0, dtype=np.int32)
    return [none if x is None else np.asarray(x, dtype=np.int32) for x in lists]


def decode(rows: DataFrame, vocabulary: ByteLevelVocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with ``out``, the text that ``ids`` stand for.

    Bytes that are no UTF-8 become U+FFFD. Null ids give an empty text, an
    unknown id fails. A column already named ``out`` is replaced.
    """
    ready(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(Pieces(vocabulary.pieces()))

    @F.pandas_udf("string")
    def back(lists: pd.Series) -> pd.Series:
        return pd.Series([b.decode("utf-8", "replace") for b in shared.value.decode(_arrays(lists))], dtype=object)

    return rows.withColumn(out, back(F.col(ids)))


def encode_digests(
    docs: DataFrame, vocabulary: ByteLevelVocabulary, doc_id: str = "doc_id", text: str = "text", hot_bytes: int = HOT_BYTES
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, encoded and decoded again.

    Null and empty texts: no tokens, digests of nothing.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces(vocabulary.pieces()))
    return _encoded(docs, vocabulary, doc_id, text, hot_bytes, Digests(pieces))
