"""Byte-level BPE encoding and decoding by a two-tier lookup (operator 10).

Tier one: a minimal perfect hash over the vocabulary resolves a whole pre-token
at once. Tier two: a pre-token outside the vocabulary is merged by a heap of
neighbouring pairs over linked bytes, lowest rank first, leftmost on ties.

The rank file is read on the driver from a path that is a parameter, packed
into numpy arrays of fixed size and broadcast: its size is the vocabulary's,
not the corpus's.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.common import python_ready

CACHE_WORDS = 300_000
CHUNK_CHARS = 1 << 21
OUT = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank to a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PerfectHash:
    """Hash and displace: ``n`` tokens in ``n`` places, one probe and one comparison to a lookup."""

    def __init__(self, tokens: list[bytes]):
        n = self.n = len(tokens)
        self.buckets = max(1, n)
        hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in tokens], dtype=np.uint64)
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        self.place = np.full(n, -1, dtype=np.int32)
        home = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        edges = np.searchsorted(home[order], np.arange(self.buckets + 1))
        groups = sorted(((order[a:b], k) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a), key=lambda g: -len(g[0]))
        for members, bucket in groups:
            if len(members) == 1:
                break
            own, d = hashes[members], 0
            while True:
                spots = self.mixed(own, d) % np.uint64(n)
                if (self.place[spots] < 0).all() and len(np.unique(spots)) == len(spots):
                    break
                d += 1
            self.place[spots], self.shift[bucket] = members, d
        # buckets of one token take the free places by number, written as negative shifts
        free = np.flatnonzero(self.place < 0)
        alone = [(members[0], bucket) for members, bucket in groups if len(members) == 1]
        for (member, bucket), spot in zip(alone, free, strict=True):
            self.place[spot], self.shift[bucket] = member, -int(spot) - 1

    @staticmethod
    def mixed(h: np.ndarray, d) -> np.ndarray:
        # fixed values: the odd multipliers of the 64-bit finaliser of MurmurHash3
        with np.errstate(over="ignore"):
            x = h ^ (np.asarray(d, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
            x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            return x ^ (x >> np.uint64(33))

    def places(self, words: list[bytes]) -> np.ndarray:
        """Position in the token list at which each word would stand; the caller compares."""
        h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
        shift = self.shift[h % np.uint64(self.buckets)]
        moved = (self.mixed(h, np.maximum(shift, 0)) % np.uint64(self.n)).astype(np.int64)
        return self.place[np.where(shift < 0, -shift - 1, moved)]


class Codec:
    """Encoder and decoder over one rank table and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.tokens = list(ranks)
        self.ids = np.fromiter(ranks.values(), dtype=np.int64, count=len(ranks))
        self.hash = PerfectHash(self.tokens) if ranks else None

    def ready(self) -> Codec:
        """Build what workers derive for themselves: pair ranks, byte table, pattern, cache."""
        if not hasattr(self, "pairs"):
            import regex

            rank = dict(zip(self.tokens, self.ids.tolist(), strict=True))
            self.byte = [rank.get(bytes([b]), -1) for b in range(256)]
            # every cut of a token into two tokens: the merges that give it
            self.pairs = {
                (rank[t[:k]] << 32) | rank[t[k:]]: r for t, r in rank.items() for k in range(1, len(t)) if t[:k] in rank and t[k:] in rank
            }
            self.by_id = np.full(int(self.ids.max(initial=-1)) + 1, -1, dtype=np.int64)
            self.by_id[self.ids] = np.arange(len(self.ids))
            self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
            self.starts = np.cumsum(self.lengths) - self.lengths
            self.flat = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
            self.split = regex.compile(self.pattern)
            self.packed = [int(i).to_bytes(4, "little") for i in self.ids]
            self.young: dict[str, bytes] = {}
            self.old: dict[str, bytes] = {}
        return self

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("pattern", "tokens", "ids", "hash")}

    def merge(self, word: bytes) -> bytes:
        """Merge the bytes of one pre-token: a heap of pairs over a doubly linked list."""
        byte, pair = self.byte, self.pairs.get
        part = [byte[b] for b in word]
        if -1 in part:
            raise ValueError("the rank table lacks a single byte of the text")
        n = len(part)
        # rank of the pair that begins at each place; an entry of the heap holds only while it equals this
        rank = [pair((a << 32) | b, -1) for a, b in zip(part, part[1:], strict=False)]
        rank.append(-1)
        heap = [(r << 32) | i for i, r in enumerate(rank) if r >= 0]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            if rank[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            part[i], part[j], rank[j] = r, -1, -1
            if k < n:
                before[k] = i
                q = rank[i] = pair((r << 32) | part[k], -1)
                if q >= 0:
                    heappush(heap, (q << 32) | i)
            else:
                rank[i] = -1
            h = before[i]
            if h >= 0:
                q = rank[h] = pair((part[h] << 32) | r, -1)
                if q >= 0:
                    heappush(heap, (q << 32) | h)
        kept = [x for x in part if x >= 0]
        return pack(f"<{len(kept)}I", *kept)

    def resolve(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of distinct pre-tokens: tier one by the perfect hash, tier two by the heap."""
        raw = [w.encode() for w in words]
        spots = self.hash.places(raw).tolist() if self.hash else [-1] * len(raw)
        tokens, packed, merge = self.tokens, self.packed, self.merge
        return {
            word: packed[spot] if spot >= 0 and tokens[spot] == data else merge(data)
            for word, data, spot in zip(words, raw, spots, strict=True)
        }

    def lookup(self, words: set[str]) -> dict[str, bytes]:
        """Packed ids of ``words``, those met before from two generations of a bounded cache."""
        young, old = self.young, self.old
        missing = []
        for w in words.difference(young):
            seen = old.get(w)
            if seen is None:
                missing.append(w)
            else:
                young[w] = seen
        young.update(self.resolve(missing))
        if len(young) > CACHE_WORDS:
            self.old, self.young = young, {}
        return young

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        pieces = [self.split.findall(t) for t in texts]
        get = self.lookup({w for p in pieces for w in p}).__getitem__
        return [b"".join(map(get, p)) for p in pieces]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed([text])[0], dtype="<u4").tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids: one gather from the concatenated vocabulary."""
        if not len(ids):
            return b""
        places = self.by_id[ids]
        if places.min() < 0:
            raise ValueError("an id outside the vocabulary")
        lengths = self.lengths[places]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.starts[places] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()


def chunks(texts: list[str]):
    """Slices of a batch of about ``CHUNK_CHARS`` characters; a longer text stands alone."""
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > CHUNK_CHARS:
            yield texts[start:k]
            start, size = k, 0
        size += len(t)
    yield texts[start:]


def token_digests(codec: Codec, texts: list[str]) -> pd.DataFrame:
    codec.ready()
    rows = []
    for part in chunks(texts):
        for packed in codec.encode_packed(part):
            ids = np.frombuffer(packed, dtype="<u4")
            rows.append((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
    return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])


def codec_for(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def _shared(spark: SparkSession, codec: Codec):
    python_ready(spark)
    return spark.sparkContext.broadcast(codec)


def encode(docs: DataFrame, codec: Codec, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``, the token ids of each whole text as ``array<int>``; a null text has none (empty).

    A column already named ``out`` is replaced. Rows, repeated or empty, stay
    where they are: there is no shuffle.
    """
    shared = _shared(docs.sparkSession, codec)

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        own = shared.value.ready()
        parts = chunks(texts.fillna("").tolist())
        return pd.Series([np.frombuffer(x, dtype="<i4") for part in parts for x in own.encode_packed(part)], dtype=object)

    return docs.withColumn(out, ids(F.col(text)))


def decode(rows: DataFrame, codec: Codec, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the bytes that ``ids`` stand for; null ids give empty bytes, an unknown id fails."""
    shared = _shared(rows.sparkSession, codec)

    @F.pandas_udf("binary")
    def back(lists: pd.Series) -> pd.Series:
        own = shared.value.ready()
        return pd.Series([b"" if x is None else own.decode(np.asarray(x)) for x in lists], dtype=object)

    return rows.withColumn(out, back(F.col(ids)))


def encode_digests(docs: DataFrame, codec: Codec, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row and the columns ``carry``; encoding and decoding in one pass.

    A null text counts as empty: no tokens, digests of nothing. Other columns,
    whatever their names, are not read. One row out for each row in.
    """
    shared = _shared(docs.sparkSession, codec)

    @F.pandas_udf(OUT)
    def digests(texts: pd.Series) -> pd.DataFrame:
        return token_digests(shared.value, texts.fillna("").tolist())

    return docs.select(F.col(doc_id).alias("doc_id"), *carry, digests(F.col(text)).alias("_d")).select("doc_id", "_d.*", *carry)
