"""Rows that the given tables do not hold: wide ids, rare languages, repeated ids, junk texts, clashing columns."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from veritrail.llm import fingerprint, html_text, langid, secret_scan, toxicity
from veritrail.llm.queries import LLM_QUERIES

LONG = "It is the story of a man who was in the house and on the hill with his dog for all of the day. " * 3


# -- 5 next document

def plain_next(rows):
    """Rows by descending id, nulls last, each with the text after it; only ids that come once have one answer."""
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    return {r[0]: ordered[(k + 1) % len(ordered)] for k, r in enumerate(ordered)}


@pytest.mark.parametrize("ids", [
    [-9 * 10**18, 9 * 10**18, 5],
    [*range(300), 2**40],
    [-(2**63), 2**63 - 1, 0, *range(10**15, 10**15 + 200)],
    [random.Random(4).getrandbits(64) - 2**63 for _ in range(500)],
])
def test_next_document_whatever_the_ids(spark, ids):
    rows = [(i, f"text {i}") for i in ids]
    docs = spark.createDataFrame(rows, "doc_id bigint, t string")
    got = fingerprint.with_next(docs, ["t"], chunk_rows=16).collect()
    want = plain_next(rows)
    assert sorted(r["doc_id"] for r in got) == sorted(ids)
    assert all(r["next_t"] == want[r["doc_id"]][1] for r in got)


def test_ranges_of_ids_are_even(spark):
    """An outlier, an id on a third of all rows and null ids do not crowd a window."""
    rows = [(k, f"a{k}") for k in range(1000)] + [(2**60, "far")] + [(7, f"same {k}") for k in range(1000)] + [(None, f"none {k}") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, t string")
    bounds = fingerprint.id_bounds(docs.where("doc_id is not null").select(F.col("doc_id").alias("id")), 2001, 50)
    salt = F.xxhash64("t").bitwiseAND(F.lit((1 << 63) - 1))
    sizes = docs.groupBy(fingerprint.chunk_of(F.col("doc_id"), salt, bounds, 10).alias("c")).count().collect()
    assert max(r["count"] for r in sizes) <= 150 and len(sizes) >= 40
    got = fingerprint.with_next(docs, ["t"], chunk_rows=50).collect()
    # a ring: every text follows one row and is followed by one
    after = {r["t"]: r["next_t"] for r in got}
    assert len(after) == len(rows) == len(set(after.values()))
    at, seen = "far", []
    for _ in rows:
        seen.append(at)
        at = after[at]
    ids = {t: i for i, t in rows}
    assert at == "far" and len(set(seen)) == len(rows)
    order = [ids[t] for t in seen]
    known = [i for i in order if i is not None]
    assert known == sorted(known, reverse=True) and order[len(known):] == [None] * 500


# -- 7 toxicity

OLD_MIXED = re.compile(r"(?<!\w)(?=[\w@$!|*]*[^\W\d_])(?=[\w@$!|*]*[\d@$|*])[\w@$!|*]{3,24}(?!\w)")


def test_mixed_words_equal_the_plain_pattern_and_are_linear():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("ab1@*! _é-$|") for _ in range(rng.randrange(40)))
        assert toxicity.mixed_words(text) == OLD_MIXED.findall(text), text
    start = time.perf_counter()
    toxicity.features("*" * 1_000_000, frozenset())
    toxicity.features("a" + "!" * 1_000_000, frozenset())
    assert time.perf_counter() - start < 20


def test_capitals_count_where_lower_case_is_longer():
    plain, longer = toxicity.features("YOU ARE BAD", frozenset()), toxicity.features("YOU ARE BAD İ", frozenset())
    assert plain[8] == plain[9] == 1 and longer[8] > 0.8 and longer[9] > 0.7


def test_sample_takes_one_row_of_a_repeated_id(spark, monkeypatch):
    taken = []
    plain = toxicity.written_table
    monkeypatch.setattr(toxicity, "written_table", lambda df, name: taken.append((name, plain(df, name))) or taken[-1][1])
    repeated = spark.range(5000).select(F.lit(1).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    docs = repeated.union(spark.range(2, 200).select("id", F.concat(F.lit("you are "), F.col("id"))))
    labels = spark.range(1, 200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    toxicity.train(docs, labels, sample=60)
    assert dict(taken)["toxic-sample"].count() <= 60
    toxicity.train(docs, labels, sample=1000)
    ids = [r["doc_id"] for r in taken[-2][1].collect()]
    assert len(ids) == len(set(ids))


# -- 9 languages

def test_a_rare_language_is_learned_and_a_repeated_id_gives_one_text(spark, monkeypatch):
    got = {}
    monkeypatch.setattr(langid, "fit", lambda texts, langs: got.update(texts=texts, langs=langs))
    big = spark.range(60_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("words "), F.col("id")).alias("text"), F.concat(F.lit("big"), F.col("id") % 3).alias("lang"), F.lit(1).alias("p")
    )
    rare = spark.range(100_000, 100_060).select("id", F.concat(F.lit("mots "), F.col("id")), F.lit("rare"), F.lit(1))
    again = spark.range(3000).select(F.lit(100_001).cast("bigint"), F.concat(F.lit("x"), F.col("id")), F.lit("rare"), F.lit(1))
    langid.train(big.union(rare).union(again), sample=120)
    per = {lang: got["langs"].count(lang) for lang in set(got["langs"])}
    assert set(per) == {"big0", "big1", "big2", "rare"} and all(25 <= n <= 30 for n in per.values())
    assert sum(t.startswith("x") for t in got["texts"]) <= 1


def test_cuttings_come_from_the_whole_text():
    import numpy as np

    text = "a " * 100_000 + "b " * 100_000
    cut, _ = langid.cuttings([text] * 20, np.random.default_rng(1))
    assert any("b" in c for c in cut) and max(map(len, cut)) <= langid.CUT_CHARS


# -- 2 main text

NAMES = (
    "comment-list", "comments-area", "comment-body", "related-posts", "widget-area", "cookie-bar", "share-buttons", "ad-container",
    "newsletter-box", "discussion", "replies", "comments", "post-comments",
)
KEPT = ("no-comments", "with-sidebar", "search-policy", "single-post", "post-body", "article-content", "entry", "comment-free", "sharecropping")


@pytest.mark.parametrize("name", NAMES)
def test_compound_class_names_of_boilerplate(name):
    p = f"<p>{LONG}</p>"
    other = f'<div class="{name}">{p.replace("story", "other")}</div>'
    assert html_text.main_text(f"<article>{p}{other}</article>") == LONG.strip()
    assert html_text.main_text(f"<body><div>{p}</div>{other}</body>") == LONG.strip()
    # what holds the page stays
    assert html_text.main_text(f'<body><div class="{name}"><p>{LONG}</p></div></body>') == LONG.strip()


@pytest.mark.parametrize("name", KEPT)
def test_class_names_of_text(name):
    assert html_text.main_text(f'<article><div class="{name}"><p>{LONG}</p></div></article>') == LONG.strip()


def test_end_tags_that_close_nothing():
    start = time.perf_counter()
    page = "<b>" * 20_000 + LONG + "</i>" * 100_000 + "</b>" * 20_000
    assert html_text.main_text(f"<article>{page}</article>") == LONG.strip()
    assert time.perf_counter() - start < 20


# -- clashing columns

CLASHES = {
    "score": 0.25, "lang_pred": "q", "rejected": True, "mix_place": 3, "_file": "f", "_row": 5, "file_name": "g", "row_index": 6, "tkey": "k",
    "_spans": "s", "mix_slot": 9, "mix_row": 8, "row": 4, "n": 2, "fp": "z", "component_id": 7, "masked": "m", "_salt": 1, "_chunk": 2, "start": 1,
}


@pytest.fixture
def clashing(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = [c for c in CLASHES if c not in docs.columns]
    docs.select("*", *[F.lit(CLASHES[c]).alias(c) for c in extra]).write.parquet(f"{tmp_path}/documents.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet"), extra


def test_stages_hand_on_columns_of_any_name(spark, sf_dir, clashing):
    import corpus_pipeline

    docs, extra = clashing
    want = {c: CLASHES[c] for c in extra}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert [r.asDict() for r in out.select(*extra).distinct().collect()] == [want], name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert sorted(r["mix_place"] for r in last) == list(range(docs.count()))


def test_next_document_beside_clashing_columns(spark, clashing, tmp_path, sf_dir):
    plain = LLM_QUERIES["op5_fingerprints"](spark, sf_dir)
    assert LLM_QUERIES["op5_fingerprints"](spark, str(tmp_path)).exceptAll(plain).count() == 0


# -- 6 secrets

def test_a_text_of_many_tokens(spark):
    rng = random.Random(1)
    hashes = [f"{rng.getrandbits(160):040x}" for _ in range(20_000)]
    text = " ".join(hashes[:-1]) + " secret = " + hashes[-1]
    docs = spark.createDataFrame([(1, "a", text, len(text)), (2, "a", None, None)], "doc_id long, source string, text string, n_chars long")
    start = time.perf_counter()
    got = {r["doc_id"]: r for r in secret_scan.find_secrets(docs).collect()}
    places = [f"hex:{41 * i}:{41 * i + 40}" for i in range(19_999)]
    at = 41 * 19_999 - 1
    places += [f"assign:{at + 1}:{at + 50}", f"hex:{at + 10}:{at + 50}"]
    assert got[1]["spans"] == ",".join(places) and got[1]["n_hex"] == 20_000 and got[1]["n_assign"] == 1 and got[2]["spans"] == ""
    masked = {r["doc_id"]: r["text"] for r in secret_scan.mask_secrets(docs).collect()}
    assert masked == {1: " ".join(["[SECRET]"] * 20_000), 2: None}
    # the square of the matches would take many times this
    assert time.perf_counter() - start < 120


def test_tokens_beside_and_across_base_spans(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        cuts = lambda n, kinds: [
            (a, rng.choice(kinds), a + rng.randrange(1, 9), None) for a in (rng.randrange(3000) for _ in range(rng.randrange(n)))
        ]
        apart = []
        for s in sorted(cuts(900, [3])):
            if not apart or apart[-1][2] <= s[0]:
                apart.append(s)
        rows.append((i, sorted(cuts(40, [0, 1, 2])), apart))
    df = spark.createDataFrame(rows, f"id int, base array<{secret_scan.SPAN}>, g array<{secret_scan.SPAN}>")
    got = {r["id"]: [tuple(s) for s in r["o"]] for r in df.select("id", secret_scan._apart(F.col("g"), F.col("base"), 3).alias("o")).collect()}
    for i, base, g in rows:
        assert got[i] == [s for s in g if not any(b[0] < s[2] and s[0] < b[2] for b in base)]


def test_masks_of_overlapping_spans(spark):
    rng = random.Random(3)
    rows = []
    for i in range(20):
        text = "".join(rng.choice("abé😀 ") for _ in range(4000))
        rows.append((i, text, [(a, 0, min(4000, a + rng.choice([1, 2, 5, 300])), None) for a in (rng.randrange(4000) for _ in range(rng.randrange(1500)))]))
    df = spark.createDataFrame(rows, f"id int, t string, s array<{secret_scan.SPAN}>")
    got = {r["id"]: r["m"] for r in df.select("id", secret_scan.masked(F.col("t"), F.col("s")).alias("m")).collect()}
    for i, text, spans in rows:
        out, at = [], 0
        for a, _, b, _ in sorted(spans, key=lambda s: s[:3]):
            if a >= at:
                out += [text[at:a], "[SECRET]"]
            at = max(at, b)
        assert got[i] == "".join(out) + text[at:]
