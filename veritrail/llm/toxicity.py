"""Toxicity by gradient-boosted trees over dense features with isotonic calibration (operator 7).

Features are densities and rates over the whole text: hits in a fixed lexicon
and in one learned from labels, their distance to second-person words, capitals,
punctuation and obfuscation. Trees are trained on a bounded sample (``SAMPLE``
labelled rows) of four of five folds less one, the isotonic map on that one;
both by Spark's own learners. Scoring is one Arrow pass for the features.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import fold, python_ready
from veritrail.session import written_table

HELD_OUT_FOLD, CALIBRATION_FOLD, FOLDS = 0, 1, 5
SAMPLE = 8_000
TERMS = 2_000
MIN_EVIDENCE = 12.0
PREFIXES = (5, 6, 7)
NEAR = 5
# fixed values: insults and abuse, and second-person words, of four languages
LEXICON = frozenset(
    """idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting clown clowns fool fools pig pigs
    bastard bastards bitch shit fuck fucking asshole crap damn hate kill die ugly jerk freak creep filth vermin imbecile dumbass retard
    dummkopf trottel arschloch scheisse scheiße abschaum versager hure schwein wertlos widerlich
    imbécile connard connasse salaud merde crétin débile ordure minable dégoûtant
    estúpido estúpida imbécil mierda basura cabrón puta inútil asqueroso escoria""".split()
)
SECOND_PERSON = frozenset("you your yours yourself ur u du dich dir dein deine ihr euch tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
LEET = str.maketrans("013457@$!|", "oieastasil")
N_FEATURES = 15
_WORD = re.compile(r"[^\W_]+")
_RAW = re.compile(r"\S+")
_SPACED = re.compile(r"\b(?:[^\W\d_][.\-_* ]){3,}[^\W\d_]\b")
_MARKED = re.compile(r"[\w@$!|*]{3,}")
_MIXED = re.compile(r"(?<!\w)[\w@$!|*]{3,24}(?!\w)")
_LETTER = re.compile(r"[^\W\d_]")
_MARK = re.compile(r"[\d@$|*]")
_RUN = re.compile(r"([^\W\d_])\1\1")


def terms_of(word: str):
    yield word
    for n in PREFIXES:
        if len(word) > n:
            yield word[:n] + "*"


def mixed_words(lower: str) -> list[str]:
    """Runs of 3 to 24 letters and marks that have both a letter and a digit or mark in them or behind them.

    Each maximal run is looked at once, so a text of marks alone takes time in proportion to its length.
    """
    out = []
    for run in _MARKED.finditer(lower):
        if not (_LETTER.search(run[0]) and _MARK.search(run[0])):
            continue
        back = run[0][::-1]
        last = run.end() - 1 - max(_LETTER.search(back).start(), _MARK.search(back).start())
        for m in _MIXED.finditer(lower, run.start(), run.end()):
            if m.start() > last:
                break
            out.append(m[0])
    return out


def capitals(text: str, lower: str) -> int:
    """Characters that lower-casing changes; one that becomes several counts once."""
    if len(text) == len(lower):
        return sum(1 for a, b in zip(text, lower, strict=True) if a != b)
    return sum(c != c.lower() for c in text)


def features(text: str | None, learned: frozenset[str]) -> list[float]:
    """The ``N_FEATURES`` dense features of one whole text; all zero for an empty one."""
    text = text or ""
    lower = text.lower()
    words = _WORD.findall(lower)
    n = len(words)
    if not text:
        return [0.0] * N_FEATURES
    known: dict[str, bool] = {}
    hits, found, second = [], set(), []
    fixed = 0
    for k, w in enumerate(words):
        hit = known.get(w)
        if hit is None:
            hit = known[w] = w in LEXICON or any(t in learned for t in terms_of(w))
        if hit:
            hits.append(k)
            found.add(w)
            fixed += w in LEXICON
        if w in SECOND_PERSON:
            second.append(k)
    near = 0
    if second and hits:
        at = np.searchsorted(second, hits)
        places = np.array([-(10**9), *second, 10**9])
        near = int((np.minimum(np.abs(places[at] - hits), np.abs(places[at + 1] - hits)) <= NEAR).sum())
    mixed = mixed_words(lower)
    hidden = sum(m.translate(LEET).strip("*") in LEXICON for m in mixed) + sum(re.sub(r"[^\w]|_", "", m[0]) in LEXICON for m in _SPACED.finditer(lower))
    letters = sum(map(len, words)) or 1
    upper = capitals(text, lower)
    caps = sum(w.isupper() and len(w) > 2 for w in _RAW.findall(text)) if upper else 0
    loud = text.count("!") + text.count("?")
    marks = len(text) - sum(map(len, words)) - sum(map(text.count, " \n\t"))
    per = 1.0 / max(1, n)
    return [
        fixed * per, math.log1p(fixed), len(hits) * per, math.log1p(len(hits)), math.log1p(len(found)), near * per, math.log1p(near),
        len(second) * per, upper / letters, caps * per, loud * per, marks * per, len(mixed) * per, math.log1p(hidden),
        len(_RUN.findall(lower)) * per,
    ]


def with_features(rows: DataFrame, learned: frozenset[str], text: str = "text", out: str = "features") -> DataFrame:
    spark = rows.sparkSession
    python_ready(spark)
    shared = spark.sparkContext.broadcast(learned)  # at most TERMS short strings

    @F.pandas_udf("array<double>")
    def dense(batch: pd.Series) -> pd.Series:
        return pd.Series([features(None if t is None or t is pd.NA else t, shared.value) for t in batch], dtype=object)

    return rows.withColumn(out, dense(F.col(text)))


def learn_terms(rows: DataFrame) -> frozenset[str]:
    """Words and word beginnings that mark label 1 in ``rows(text, toxic)``, at most ``TERMS`` of them.

    A term counts once to a text. It stays where its texts are toxic much more
    often than all are, by the log-likelihood of its toxic texts.
    """
    share = rows.agg(F.avg("toxic")).first()[0] or 0.0
    if not 0 < share < 1:
        return frozenset()
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    terms = [F.col("w")]
    for n in PREFIXES:
        terms.append(F.transform(F.filter("w", lambda x, n=n: F.length(x) > n), lambda x, n=n: F.concat(F.substring(x, 1, n), F.lit("*"))))
    each = rows.select("toxic", words.alias("w")).select("toxic", F.explode(F.array_distinct(F.concat(*terms))).alias("term"))
    counts = each.groupBy("term").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n"))
    rate = F.col("pos") / F.col("n")
    evidence = F.col("pos") * F.log(rate / share)
    best = counts.where((F.col("pos") >= 5) & (rate >= max(0.5, min(0.9, 3 * share)))).withColumn("e", evidence)
    best = best.where(F.col("e") >= MIN_EVIDENCE).orderBy(F.desc("e"), "term").limit(TERMS).select("term")
    return frozenset(r["term"] for r in best.collect())


class ToxicityModel:
    """Learned terms, trees and isotonic map; without trees every text scores ``prior``."""

    def __init__(self, learned: frozenset[str] = frozenset(), trees=None, isotonic=None, prior: float = 0.0):
        self.learned, self.trees, self.isotonic, self.prior = learned, trees, isotonic, prior

    def raw(self, featured: DataFrame) -> DataFrame:
        """``featured`` with ``_raw``, the trees' own probability."""
        scored = self.trees.transform(featured.withColumn("_x", array_to_vector("features")))
        return scored.withColumn("_raw", vector_to_array("_probability").getItem(1)).drop("_x", "_margin", "_probability", "_class")

    def score(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """``rows`` with ``score``; a column of that name is replaced."""
        if self.trees is None:
            return rows.withColumn("score", F.lit(float(self.prior)))
        kept = [c for c in rows.columns if c not in ("score", text)]
        scored = self.raw(with_features(rows.select(*kept, F.col(text).alias("_text")), self.learned, "_text").drop("_text"))
        if self.isotonic is None:
            return scored.select(*kept, F.col("_raw").alias("score"))
        fine = self.isotonic.transform(scored)
        return fine.select(*kept, F.least(F.greatest(F.col("_calibrated"), F.lit(0.0)), F.lit(1.0)).alias("score"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Fit on at most ``sample`` labelled documents outside the held-out fold, those first by the hash of their id.

    Null labels, ids and texts are not learned from; an id with two labels
    counts as toxic if one of them is, and one with several texts gives one.
    """
    marks = labels.where(F.col(label).isNotNull() & (fold(doc_id, FOLDS) != HELD_OUT_FOLD)).groupBy(F.col(doc_id).alias("doc_id"))
    marks = marks.agg(F.max((F.col(label) == 1).cast("int")).alias("toxic"), F.first(F.xxhash64(doc_id)).alias("h"))
    chosen = marks.orderBy("h", "doc_id").limit(sample)
    texts = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # one row to an id, however often the documents repeat it
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = written_table(one.withColumn("fold", fold("doc_id", FOLDS)), "toxic-sample")
    seen = {(r["c"], r["toxic"]): r["n"] for r in rows.groupBy((F.col("fold") == CALIBRATION_FOLD).alias("c"), "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(seen.values())
    prior = sum(n for (_, y), n in seen.items() if y) / total if total else 0.0
    if (False, 0) not in seen or (False, 1) not in seen:
        return ToxicityModel(prior=prior)
    learned = learn_terms(rows.where(F.col("fold") != CALIBRATION_FOLD))
    featured = written_table(with_features(rows, learned).drop("text"), "toxic-features")
    vectors = featured.withColumn("_x", array_to_vector("features")).withColumn("_y", F.col("toxic").cast("double"))
    learner = GBTClassifier(
        featuresCol="_x", labelCol="_y", predictionCol="_class", maxIter=15, maxDepth=3, stepSize=0.3, maxBins=64, seed=3
    )
    learner = learner.setProbabilityCol("_probability").setRawPredictionCol("_margin")
    model = ToxicityModel(learned, learner.fit(vectors.where(F.col("fold") != CALIBRATION_FOLD)), None, prior)
    if (True, 0) in seen and (True, 1) in seen:
        held = model.raw(featured.where(F.col("fold") == CALIBRATION_FOLD)).withColumn("_y", F.col("toxic").cast("double"))
        model.isotonic = IsotonicRegression(featuresCol="_raw", labelCol="_y", predictionCol="_calibrated").fit(held)
    return model


def held_out(doc_id: str) -> Column:
    return F.coalesce(fold(doc_id, FOLDS) == HELD_OUT_FOLD, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    A null text counts as empty and is scored like one. Where nothing can be
    learned every score is the share of toxic labels seen, 0 without labels.
    Null ids stay and are in no fold; repeated rows stay; other columns are not read.
    Features take time in proportion to the text, however long it is.
    """
    model = train(docs, labels, doc_id=doc_id, text=text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scored = model.score(rows).select("doc_id", held_out("doc_id").alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
