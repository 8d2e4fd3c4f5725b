"""Language identification by averaged hashed subword embeddings (operator 9).

A text is the mean of the embeddings of its hashed character n-grams; a linear
softmax over that mean names the language. Both are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled documents
(``SAMPLE`` rows, balanced over languages). A temperature calibrates the
probabilities on sampled documents left out of training. The rejection threshold
is the lowest score at which accepted ones reach ``ACCEPT`` accuracy, but never
one that rejects more than ``LOSS`` of the rightly named.

A softmax is sure of texts it has never seen the like of, so a text must also be
typical of some learned language: the mean log likelihood of its n-grams there is
held against a limit for texts of its length. Limits lie between the ``LOSS``
quantile of cuttings in their own language and the median of negatives: the same
cuttings with their language left out, and with their characters shuffled.

Embedding and softmax are both linear, so the model is folded into one small
table of n-gram logits before it is sent to the workers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.llm.common import fold, python_ready

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15  # n-grams are held as 16-bit numbers
DIM = 16
SAMPLE = 3_000
EPOCHS = 4
RATE = 0.5
ACCEPT = 0.99
LOSS = 0.005
REACH, LEAST_GAP = 0.6, 1.0  # limits lie this share of the way to the negatives, which count as so far off at least
LEAST_RIGHT = 20  # fewer calibration rows, or cuttings of a length, tell nothing
CUT_WORDS = tuple(1 << k for k in range(11))
CUT_CHARS = 1 << 13
HELD_OUT_FOLD, FOLDS = 2, 4
CHUNK_CHARS = 1 << 19


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts and the text each belongs to.

    Texts are lower-cased; every character that is not a letter counts as a
    blank, so n-grams see word edges. N-grams that hold no letter are left out.
    """
    joined = " " + "  ".join(t.lower() for t in texts) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    lengths = np.array([len(t.lower()) + 2 for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)[: len(codes)]
    top = int(codes.max(initial=0)) + 1
    kinds = np.zeros(top, dtype=bool)
    present = np.flatnonzero(np.bincount(codes, minlength=top))
    kinds[present] = [chr(c).isalpha() for c in present]
    letter = kinds[codes]
    codes = np.where(letter, codes, 32)
    found, owners = [], []
    for n in ORDERS:
        m = len(codes) - n + 1
        h = np.full(m, n * 2654435761, dtype=np.int64)
        some = np.zeros(m, dtype=bool)
        for k in range(n):
            h = (h * 31 + codes[k : k + m]) * 16777619 & 0xFFFFFFFF
            some |= letter[k : k + m]
        whole = some & (owner[:m] == owner[n - 1 :])
        found.append(((h ^ (h >> 15)) % BUCKETS)[whole])
        owners.append(owner[:m][whole])
    return np.concatenate(found), np.concatenate(owners)


def pieces_of(texts: list[str]):
    """Lists of ``(text number, piece)`` of about ``CHUNK_CHARS`` characters; a longer text is cut, its n-grams add up."""
    part, size = [], 0
    for k, text in enumerate(texts):
        for start in range(0, max(1, len(text)), CHUNK_CHARS):
            piece = text[start : start + CHUNK_CHARS]
            if part and size + len(piece) > CHUNK_CHARS:
                yield part
                part, size = [], 0
            part.append((k, piece))
            size += len(piece) + 2
    if part:
        yield part


def gram_counts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct n-grams of each text and how often each comes, as small integers."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for part in pieces_of(texts):
        h, owner = grams([piece for _, piece in part])
        order = np.argsort(owner, kind="stable")
        h = h[order].astype(np.uint16)
        for (k, _), own in zip(part, np.split(h, np.searchsorted(owner[order], np.arange(1, len(part)))), strict=True):
            found[k].append(own)
    return [tuple(x.astype(t) for x, t in zip(np.unique(np.concatenate(f), return_counts=True), (np.uint16, np.int32), strict=True)) for f in found]


@dataclass
class LanguageModel:
    """Languages and folded logits; without languages every text is ``und`` with score 0."""

    langs: list[str] = field(default_factory=list)
    table: np.ndarray | None = None
    bias: np.ndarray | None = None
    temperature: float = 1.0
    threshold: float = 0.0
    likelihood: np.ndarray | None = None  # of each n-gram in each language, as logarithm
    limits: np.ndarray | None = None  # of the mean likelihood, by the binary logarithm of the number of n-grams

    def means(self, texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean over the n-grams of each text of each column of ``table``, and their number."""
        sums, n = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), dtype=np.int64)
        for part in pieces_of(texts):
            h, owner = grams([piece for _, piece in part])
            at = np.array([k for k, _ in part])
            np.add.at(n, at, np.bincount(owner, minlength=len(part)))
            for k in range(table.shape[1]):
                np.add.at(sums[:, k], at, np.bincount(owner, table[h, k], minlength=len(part)))
        return sums / np.maximum(n, 1)[:, None], n

    def untypical(self, means: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Which mean likelihoods are below the limit for their number of n-grams."""
        return means < self.limits[np.minimum(length_class(n), len(self.limits) - 1)]

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        known = [t or "" for t in texts]
        if not self.langs or not known:
            return pd.DataFrame({"lang_pred": ["und"] * len(known), "score": 0.0, "rejected": True})
        both = self.table if self.limits is None else np.hstack([self.table, self.likelihood])
        found, n = self.means(known, both)
        p = softmax((found[:, : len(self.langs)] + self.bias) / self.temperature)
        best = p.argmax(axis=1)
        score = np.where(n == 0, 0.0, p.max(axis=1))
        names = ["und" if m == 0 else self.langs[b] for b, m in zip(best, n, strict=True)]
        rejected = (n == 0) | (score < self.threshold)
        if self.limits is not None:
            # of any language: one that is learned but misnamed is no unlearned one
            rejected |= self.untypical(found[:, len(self.langs) :].max(axis=1), n)
        return pd.DataFrame({"lang_pred": names, "score": score, "rejected": rejected})


def length_class(n: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(n, 1)).astype(np.int64)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def likelihoods(rows: list[tuple], langs: int) -> np.ndarray:
    """Logarithm of each n-gram's share in each language; a long text counts no more than one of ``CUT_CHARS`` n-grams."""
    counts = np.full((BUCKETS, langs), 0.5)
    for (u, c), y in rows:
        counts[u, y] += c * min(1.0, CUT_CHARS / c.sum())
    return np.log(counts / counts.sum(axis=0))


def cuttings(texts: list[str], rng: np.random.Generator) -> tuple[list[str], np.ndarray]:
    """Runs of words of every length in ``CUT_WORDS`` and whole shorter texts, and the text each is from.

    They come from anywhere in the whole text; one of more than ``CUT_CHARS`` characters gives as many of its own.
    """
    out, owner = [], []
    for k, text in enumerate(texts):
        words = text.split()
        for size in CUT_WORDS:
            at = int(rng.integers(max(1, len(words) - size + 1)))
            cut = " ".join(words[at : at + size])
            if len(cut) > CUT_CHARS:
                start = int(rng.integers(len(cut) - CUT_CHARS + 1))
                cut = cut[start : start + CUT_CHARS]
            out.append(cut)
            owner.append(k)
            if size >= len(words):
                break
    return out, np.array(owner, dtype=np.int64)


def limits(model: LanguageModel, texts: list[str], y: np.ndarray, rng: np.random.Generator) -> np.ndarray | None:
    """The limit of the mean likelihood for each ``length_class``; None where too few texts tell it.

    A class with too few cuttings takes the limit of the next shorter one.
    """
    if len(texts) < LEAST_RIGHT:
        return None
    cut, owner = cuttings(texts, rng)
    own = y[owner]
    found, n = model.means(cut, model.likelihood)
    right = found[np.arange(len(cut)), own]
    mixed, _ = model.means(["".join(rng.permutation(list(c))) if c else "" for c in cut], model.likelihood)
    negatives = mixed.max(axis=1)[:, None]
    if len(model.langs) > 1:
        found[np.arange(len(cut)), own] = -np.inf
        negatives = np.hstack([negatives, found.max(axis=1)[:, None]])
    classes = length_class(n)
    out = np.full(max(1, int(classes.max(initial=0)) + 1), -np.inf)
    for k in range(len(out)):
        here = (classes == k) & (n > 0)
        if here.sum() >= LEAST_RIGHT:
            low = np.quantile(right[here], LOSS)
            out[k] = low - REACH * max(low - np.median(negatives[here]), LEAST_GAP)
        elif k:
            out[k] = out[k - 1]
    return out


def fit(texts: list[str], langs: list[str], seed: int = 7) -> LanguageModel:
    """Train by plain SGD, one document to a step; every fifth document calibrates."""
    counts = gram_counts(texts) if texts else []
    some = [(c, lang) for c, lang in zip(counts, langs, strict=True) if len(c[0])]
    whole = [t for t, c in zip(texts, counts, strict=False) if len(c[0])]
    if not some:
        return LanguageModel()
    names = sorted({lang for _, lang in some})
    rows = [(c, names.index(lang)) for c, lang in some]
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    out = np.zeros((DIM, len(names)))
    bias = np.zeros(len(names))
    train = [r for k, r in enumerate(rows) if k % 5] or rows
    held = [r for k, r in enumerate(rows) if k % 5 == 0] or rows
    steps, step = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(train)):
            rate = RATE * (1 - step / steps)
            step += 1
            (u, c), y = train[k]
            share = c / c.sum()
            mean = share @ emb[u]
            p = softmax((mean @ out + bias)[None])[0]
            p[y] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= rate * p
            # the mean spreads its gradient thinly over n-grams; a per-row norm keeps rare ones learning
            emb[u] -= rate * np.outer(share / share.max(), back)
    model = LanguageModel(names, emb @ out, bias)
    z = np.stack([(c / c.sum()) @ model.table[u] + bias for (u, c), _ in held])
    y = np.array([y for _, y in held])
    grid = np.geomspace(0.05, 20, 60)
    losses = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(losses))])
    p = softmax(z / model.temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-score, kind="stable")
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= ACCEPT
    kept = np.flatnonzero(good)
    wanted = 0.0 if good[-1] else float(score[order][kept[-1]]) if len(kept) else 1.0
    # no more than LOSS of the rightly named may go; too few of them to tell that share: none goes
    spare = int(LOSS * right.sum())
    model.threshold = min(wanted, float(np.sort(score[right])[spare])) if spare else 0.0
    model.likelihood = likelihoods(train, len(names))
    if held is not rows:
        calibrating = [t for k, t in enumerate(whole) if k % 5 == 0]
        model.limits = limits(model, [t for t, r in zip(calibrating, right, strict=True) if r], y[right], rng)
    return model


def train(docs: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fit on at most ``sample`` whole labelled texts outside the held-out fold, one of each language at least.

    Each language gives the same number, those whose hashed id comes first, or
    all it has; the number of a language's ids, estimated, comes from all rows. A repeated id gives
    one text. Rows with a null id, text or language are not learned from.
    """
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = given.where((fold("doc_id", FOLDS) != HELD_OUT_FOLD) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).collect()}
    if not counts:
        return LanguageModel()
    each = max(1, sample // len(counts))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.2 * each / n + 20 / n))])
    place = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 62) - 1)) / F.lit(float(1 << 62))
    # a bounded number of ids to a language passes the first limit, ``each`` of them the second
    taken = rows.withColumn("p", place).where(F.col("p") <= share[F.col("lang")])
    taken = taken.groupBy("lang", "doc_id", "p").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("p", "doc_id"))
    got = taken.withColumn("k", first).where(F.col("k") <= each).select("lang", "text", "p", "doc_id").collect()
    got.sort(key=lambda r: (r["p"], r["lang"], r["doc_id"]))
    return fit([r["text"] for r in got], [r["lang"] for r in got])


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred, score, rejected``; columns of these names are replaced. No shuffle."""
    spark = docs.sparkSession
    python_ready(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def named(texts: pd.Series) -> pd.DataFrame:
        return shared.value.predict([None if t is None or t is pd.NA else t for t in texts])

    outs = ("lang_pred", "score", "rejected")
    kept = [c for c in docs.columns if c not in outs]
    return docs.select(*kept, named(F.col(text)).alias("_lid")).select(*kept, *[F.col(f"_lid.{c}").alias(c) for c in outs])


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every row.

    Rejected is what the calibrated score or the limit of its length turns away:
    unlearned languages and gibberish, the surer the longer.
    ``und`` with score 0, rejected, for a null text or one without a letter, and
    for all rows where nothing can be learned. A null id is in no fold: its
    ``held_out`` is false, and it is not learned from. Repeated rows stay.
    """
    model = train(docs, doc_id=doc_id, text=text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    held = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT_FOLD, F.lit(False))
    return predict(rows, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
