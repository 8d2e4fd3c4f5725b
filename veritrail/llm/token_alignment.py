"""Alignment of two tokenizers over the same texts (operator 12).

In every batch both sides become frames of token starts, document by document, and
two ``merge_asof`` let each token start find the token of the other side that
covers it. The union of both directions holds every overlapping pair once;
places where tokens of both sides end cut the sequences into groups.

Corpus-wide counts of id pairs are a Spark aggregate. They come back to the
documents by a lookup of bounded size for frequent pairs and by joins for all
others.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.llm.space_words import PYTHON_CUT, frequent
from veritrail.llm.word_bpe import byte_letters, gather, lists_of, ready
from veritrail.session import written_table

#: id pairs that are shipped to the tasks take this much at most
HOT_BYTES = 32 * 1024 * 1024
PAIR_BYTES = 24
#: characters that are aligned together, and words whose ids a task keeps
CHUNK_CHARS = 1 << 20
KEPT_WORDS = 400_000

FACTS = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
ALIGNED = f"{FACTS}, a array<int>, b array<int>, times array<int>"
WEIGHED = f"{FACTS}, count_sum bigint, n_best bigint, rare array<struct<a:int,b:int,times:int>>"


class ByteLevelSide:
    """A byte-level tokenizer file, with special tokens as plain text."""

    def __init__(self, text: str):
        self.text = text

    def open(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(self.text)
        self.tokenizer.encode_special_tokens = True
        letters = byte_letters()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.pieces = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


class PieceSide:
    """A sentence-piece model, which writes a space before the text itself."""

    def __init__(self, model: bytes):
        self.model = model

    def open(self) -> None:
        import sentencepiece

        self.processor = own = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        names = [own.id_to_piece(i) for i in range(own.get_piece_size())]
        if any("▁" in name.lstrip("▁") for name in names):
            raise ValueError("pieces reach across spaces: texts cannot be cut at them")
        self.pieces = {
            i: bytes([int(name[1:-1], 16)]) if own.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)
        }

    def encode(self, words: list[str]) -> list[list[int]]:
        # every word begins with the space that the model adds
        return self.processor.encode([w[1:] for w in words], num_threads=1)


class Side:
    """One tokenizer in a task: ids of words from a bounded cache, bytes and decimal forms of ids."""

    def __init__(self, source: ByteLevelSide | PieceSide):
        source.open()
        self.source = source
        size = max(source.pieces) + 1
        joined = [source.pieces.get(i, b"") for i in range(size)]
        self.lengths = np.array([len(p) for p in joined], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(joined), dtype=np.uint8)
        # decimal ids with what follows them: a comma, or at ``size`` and beyond the mark of a group's last token
        self.size, mark = size, "|" if isinstance(source, ByteLevelSide) else ";"
        self.decimals = np.array([f"{i}{end}" for end in (",", mark) for i in range(size)], dtype=object)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, words: list[list[str]], distinct: set[str]) -> list[np.ndarray]:
        """Ids of each text, given as its words and the distinct words of all."""
        young, old = self.young, self.old
        missing = []
        for w in distinct.difference(young):
            if (seen := old.get(w)) is None:
                missing.append(w)
            else:
                young[w] = seen
        young.update(zip(missing, (array("i", x).tobytes() for x in self.source.encode(missing)), strict=True))
        get = young.__getitem__
        out = [np.frombuffer(b"".join(map(get, text)), dtype=np.int32) for text in words]
        if len(young) > KEPT_WORDS:
            self.old, self.young = young, {}
        return out

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.starts[ids], self.lengths[ids])

    def faithful(self, lists: list[np.ndarray], raws: list[bytes]) -> np.ndarray:
        """Whose joined token bytes are the text's bytes."""
        sizes = np.array([self.lengths[x].sum() for x in lists])
        same = sizes == np.array([len(r) for r in raws])
        kept = np.flatnonzero(same)
        if len(kept):
            joined = self.spelled(np.concatenate([lists[k] for k in kept]))
            wrong = np.flatnonzero(joined != np.frombuffer(b"".join(raws[k] for k in kept), dtype=np.uint8))
            same[kept[np.searchsorted(np.cumsum(sizes[kept]), wrong, side="right")]] = False
        return same

    def frame(self, lists: list[np.ndarray], name: str) -> pd.DataFrame:
        """Tokens in order: document, place of the first byte in the batch, and id."""
        ids = np.concatenate(lists)
        lengths = self.lengths[ids]
        doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        start = np.cumsum(lengths) - lengths
        return pd.DataFrame({"doc": doc, "start": start, f"{name}_id": ids, f"{name}_start": start})


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Each A token with the B token that covers its first byte, and the reverse.

    Starts are places in the batch, and both sides of a document fill the same
    places from its first on, so no token meets one of another document.
    """
    right_b = b[["start", "b_id", "b_start"]]
    right_a = a[["start", "a_id", "a_start"]]
    forth = pd.merge_asof(a[["doc", "start", "a_id"]], right_b, on="start")
    back = pd.merge_asof(b[["doc", "start", "b_id"]], right_a, on="start")
    return forth, back


def align(side_a: Side, side_b: Side, lists_a: list[np.ndarray], lists_b: list[np.ndarray]) -> dict[str, list]:
    """Counts, digest and distinct id pairs of documents whose tokens spell the same bytes."""
    a, b = side_a.frame(lists_a, "a"), side_b.frame(lists_b, "b")
    forth, back = overlaps(a, b)
    # both sides start here, so both ended just before: a group begins
    opens_a = (forth["b_start"] == forth["start"]).to_numpy()
    opens_b = (back["a_start"] == back["start"]).to_numpy()
    group_a, group_b = np.cumsum(opens_a) - 1, np.cumsum(opens_b) - 1
    # a pair whose starts are equal is found in both directions
    later = back[~opens_b]
    # one number for document and pair: sorting it is far cheaper than an order by two keys
    keys = [(x["doc"].to_numpy() * side_a.size + x["a_id"].to_numpy()) * side_b.size + x["b_id"].to_numpy() for x in (forth, later)]
    key, times = np.unique(np.concatenate(keys), return_counts=True)
    key, id_b = np.divmod(key, side_b.size)
    doc, id_a = np.divmod(key, side_a.size)
    pair = (id_a << 32) | id_b
    n = len(lists_a)

    # decimal ids with what follows them: A tokens of a group, then its B tokens
    last_a, last_b = np.append(opens_a[1:], True), np.append(opens_b[1:], True)
    ids_a, ids_b = a["a_id"].to_numpy(), b["b_id"].to_numpy()
    size_a, size_b = np.bincount(group_a), np.bincount(group_b)
    place_a = np.arange(len(ids_a)) + (np.cumsum(size_b) - size_b)[group_a]
    place_b = np.arange(len(ids_b)) + np.cumsum(size_a)[group_b]
    written = np.empty(len(ids_a) + len(ids_b), dtype=object)
    written[place_a] = side_a.decimals[ids_a + last_a * side_a.size]
    written[place_b] = side_b.decimals[ids_b + last_b * side_b.size]
    n_a, n_b = np.bincount(a["doc"], minlength=n), np.bincount(b["doc"], minlength=n)
    ends = np.append(0, np.cumsum(n_a + n_b))
    digests = [hashlib.sha256("".join(written[s:e].tolist())[:-1].encode()).hexdigest() for s, e in zip(ends[:-1], ends[1:], strict=True)]
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(a["doc"][opens_a], minlength=n),
        "n_links": np.bincount(doc, weights=times, minlength=n).astype(np.int64), "groups_sha256": digests,
        "distinct": np.bincount(doc, minlength=n), "pair": pair, "times": times,
    }


def aligned_texts(side_a: Side, side_b: Side, texts: list[str]) -> dict[str, list]:
    """``align`` for all texts; those without tokens get zeros and an empty digest."""
    spaced = [" " + t for t in texts]
    full = [k for k, t in enumerate(texts) if t]
    words = [PYTHON_CUT.split(spaced[k]) for k in full]
    distinct = set(chain.from_iterable(words))
    lists_a, lists_b = side_a.ids(words, distinct), side_b.ids(words, distinct)
    raws = [spaced[k].encode() for k in full]
    good = side_a.faithful(lists_a, raws) & side_b.faithful(lists_b, raws) if full else np.zeros(0, dtype=bool)
    kept = [k for k, g in enumerate(good) if g]
    at = np.array([full[k] for k in kept], dtype=np.int64)
    out = {name: np.zeros(len(texts), dtype=np.int64) for name in ("n_a", "n_b", "n_groups", "n_links", "distinct")}
    out |= {"groups_sha256": np.full(len(texts), "", dtype=object), "pair": np.zeros(0, np.int64), "times": np.zeros(0, np.int64)}
    if kept:
        found = align(side_a, side_b, [lists_a[k] for k in kept], [lists_b[k] for k in kept])
        for name in ("n_a", "n_b", "n_groups", "n_links", "distinct", "groups_sha256"):
            out[name][at] = found[name]
        out |= {"pair": found["pair"], "times": found["times"]}
    return out


def chunked(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of a batch of about ``CHUNK_CHARS`` characters; a longer text stands alone."""
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > CHUNK_CHARS:
            yield start, k
            start, size = k, 0
        size += len(t)
    if len(texts):
        yield start, len(texts)


def align_documents(docs: DataFrame, a: ByteLevelSide, b: PieceSide, doc_id: str, text: str) -> DataFrame:
    """One row per document: counts, digest of the groups, and its distinct id pairs with how often it links them."""
    ready(docs.sparkSession)
    sides = docs.sparkSession.sparkContext.broadcast((a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = map(Side, sides.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for start, end in chunked(texts):
                got = aligned_texts(side_a, side_b, texts[start:end])
                pair, part = got["pair"], batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), *[pa.array(got[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
                        pa.array(got["groups_sha256"], pa.string()),
                        *[lists_of(pa.array(x.astype(np.int32)), got["distinct"]) for x in (pair >> 32, pair & 0xFFFFFFFF, got["times"])],
                    ],
                    [c.split()[0] for c in ALIGNED.split(", ")],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, ALIGNED)


def pair_table(aligned: DataFrame) -> DataFrame:
    """``a, b, n, best``: corpus-wide links of every id pair, and whether no other pair of ``b`` has more."""
    counts = aligned.select(F.explode(F.arrays_zip("a", "b", "times")).alias("_p")).select("_p.*").groupBy("a", "b").agg(F.sum("times").alias("n"))
    # rows of a window: at most the ids of the other vocabulary
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def weigh(aligned: DataFrame, hot: pa.Table) -> DataFrame:
    """``count_sum, n_best`` of each document over the shipped pairs, and its other pairs as ``rare``."""
    key = (hot["a"].to_numpy().astype(np.int64) << 32) | hot["b"].to_numpy()
    order = np.argsort(key)
    best = hot["best"].to_numpy(zero_copy_only=False).astype(bool)
    shared = aligned.sparkSession.sparkContext.broadcast((key[order], hot["n"].to_numpy()[order], best[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, top = shared.value
        for batch in batches:
            a, b, times = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("a", "b", "times"))
            sizes = np.diff(batch.column("a").offsets.to_numpy())
            pair = (a << 32) | b
            at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            known = keys[at] == pair if len(keys) else np.zeros(len(pair), dtype=bool)
            row = np.repeat(np.arange(len(sizes)), sizes)
            sums = np.zeros((2, len(sizes) + 1), dtype=np.int64)
            ends = np.append(0, np.cumsum(sizes))
            for k, worth in enumerate((counts, top)):
                value = np.zeros(len(pair), dtype=np.int64)
                value[known] = times[known] * worth[at[known]]
                sums[k] = np.append(0, np.cumsum(value))[ends]
            lost = np.flatnonzero(~known)
            rare = pa.StructArray.from_arrays([pa.array(x[lost].astype(np.int32)) for x in (a, b, times)], ["a", "b", "times"])
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-3], pa.array(np.diff(sums[0])), pa.array(np.diff(sums[1])),
                    lists_of(rare, np.bincount(row[lost], minlength=len(sizes))),
                ],
                [c.split()[0] for c in WEIGHED.split(", ")],
            )

    return aligned.mapInArrow(run, WEIGHED)


def alignment(
    docs: DataFrame, a: ByteLevelSide, b: PieceSide, doc_id: str = "doc_id", text: str = "text", hot_bytes: int = HOT_BYTES
) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    Texts that are null or empty, or whose tokens do not spell a space and the
    text, have no tokens: zeros and ''. Ids may be null or repeated: rows stay
    apart. Other columns, whatever their names, are not read. A very long text
    is encoded word by word and aligned as a whole, alone in its chunk.
    """
    aligned = written_table(align_documents(docs, a, b, doc_id, text), "aligned")
    pairs = written_table(pair_table(aligned), "id-pairs")
    chosen, _, beyond = frequent(pairs, "n", F.lit(PAIR_BYTES), hot_bytes)
    weighed = weigh(aligned, pairs.where(chosen).toArrow())
    if beyond:
        weighed = stored = written_table(weighed, "weighed")
        far = stored.select("row", F.explode("rare").alias("_p")).select("row", "_p.*").join(pairs.where(~chosen), ["a", "b"])
        best = F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))
        more = far.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("_sum"), F.sum(best).alias("_best"))
        weighed = stored.join(more, "row", "left").withColumns(
            {"count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("_best", F.lit(0))}
        )
    return weighed.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
