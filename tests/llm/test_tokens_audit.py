"""Distinct-word BPE, tokenizer alignment and filter audit against the libraries and plain loops."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from oracle_check import connect, differences
from veritrail.llm import filter_audit, queries, space_words, token_alignment, word_bpe
from veritrail.llm.common import table

JSON = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, word string, row int, part string, ids string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, la, "s", 1, "k", "w", 1, "p", "x") for i, t, la in rows], DOCS)


def strange_texts():
    rng = random.Random(5)
    marks = [" ", "  ", "   ", "\n", "\t", " ", " ", "　", "\u0085", "\x1c", "​", "﻿", "a", "Z", "9", "é", "ß", "中", "😀", "́",
             "'s", "'", "!", "<|endoftext|>", "<s>", "▁", "\x00", "़", "٣", "Ⅷ", " the", "hello", "᠎", " ", "½"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    return texts + ["<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>  b", " ", "   ", " lead", "trail ", "  both  ", "x" * 5000, "ab " * 40_000, "<unk>", "</s> x"]


EDGE = [(1, None, "en"), (2, "", "en"), (2, "", None), (3, "hello world", "de"), (None, "no id here", "de"), (None, None, None), (3, "hello world", "de"), (3, "other text", "")]


def digest(data):
    return hashlib.sha256(data).hexdigest()


# -- 11

def library_digests(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    back = tokenizer.decode(ids, skip_special_tokens=False)
    return len(ids), digest(np.array(ids, dtype="<u4").tobytes()), digest(back.encode())


@pytest.fixture(scope="module")
def strange(spark):
    return docs_of(spark, EDGE + [(10 + k, t, "en") for k, t in enumerate(strange_texts())])


@pytest.mark.parametrize("hot_bytes", [word_bpe.HOT_BYTES, 700, 200, 0])
def test_word_bpe_equals_the_library(spark, strange, hot_bytes):
    tokenizer = Tokenizer.from_file(JSON)
    got = word_bpe.encode_digests(strange, word_bpe.vocabulary_of(JSON), hot_bytes=hot_bytes).collect()
    want = Counter((r.doc_id, *library_digests(tokenizer, r.text)) for r in strange.collect())
    assert Counter(map(tuple, got)) == want


def test_word_bpe_over_the_table(spark, sf_dir):
    tokenizer = Tokenizer.from_file(JSON)
    want = {r.doc_id: library_digests(tokenizer, r.text) for r in table(spark, sf_dir, "documents").collect()}
    assert {r.doc_id: tuple(r)[1:] for r in queries.op11_word_bpe(spark, sf_dir).collect()} == want


def test_each_distinct_word_is_encoded_once(spark, sf_dir):
    words = word_bpe.word_counts(table(spark, sf_dir, "documents"))
    texts = [r.text for r in table(spark, sf_dir, "documents").collect()]
    want = Counter(w for t in texts for w in space_words.PYTHON_CUT.split(t))
    assert {r.word: r.n for r in words.collect()} == want
    chosen, held, beyond = space_words.frequent(words, "n", F.octet_length("word") * 3 + 16, 20_000)
    assert words.where(chosen).count() == held and 0 < held < len(want)
    assert max(r.n for r in words.where(~chosen).collect()).bit_length() == beyond
    assert min(r.n for r in words.where(chosen).collect()) > max(r.n for r in words.where(~chosen).collect())


def test_word_bpe_interface(spark):
    vocabulary = word_bpe.vocabulary_of(JSON)
    rows = word_bpe.encode(docs_of(spark, [(1, "Hello world", None)]), vocabulary)
    assert rows.first().ids == Tokenizer.from_file(JSON).encode("Hello world").ids
    assert word_bpe.decode(rows, vocabulary).first().decoded == "Hello world"
    loose = spark.createDataFrame([([i],) for i in range(0, 50257, 97)] + [([128, 300, 7],), (None,), ([],)], "ids array<int>")
    tokenizer = Tokenizer.from_file(JSON)
    for r in word_bpe.decode(loose, vocabulary).collect():
        assert r.decoded == tokenizer.decode(r.ids or [], skip_special_tokens=False)
    with pytest.raises(Exception, match="no piece for id 50257"):
        word_bpe.decode(spark.createDataFrame([([50257],)], "ids array<int>"), vocabulary).collect()
    assert word_bpe.encode_digests(docs_of(spark, []), vocabulary).count() == 0
    with pytest.raises(ValueError):
        word_bpe.vocabulary_of(public_tokenizers.path("word_bpe_49k.json"))


# -- 12

def brute_alignment(texts):
    """Every overlap by comparing byte ranges, one document at a time."""
    a_side = Tokenizer.from_file(JSON)
    a_side.encode_special_tokens = True
    letters = word_bpe.byte_letters()
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found, corpus = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = [(t, bytes(letters[c] for c in a_side.id_to_token(t))) for t in a_side.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = []
        for t in model.encode(text) if text else []:
            name = model.id_to_piece(t)
            b.append((t, bytes([int(name[3:5], 16)]) if model.is_byte(t) else name.replace("▁", " ").encode()))
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole or not text:
            found.append(None)
            continue
        ends_a, ends_b = list(itertools.accumulate(len(x) for _, x in a)), list(itertools.accumulate(len(x) for _, x in b))
        links, j = [], 0
        for i, (t, x) in enumerate(a):
            start = ends_a[i] - len(x)
            while ends_b[j] <= start:
                j += 1
            k = j
            while k < len(b) and ends_b[k] - len(b[k][1]) < ends_a[i]:
                links.append((t, b[k][0]))
                k += 1
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            to_i, to_j = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append(",".join(str(t) for t, _ in a[i:to_i]) + "|" + ",".join(str(t) for t, _ in b[j:to_j]))
            i, j = to_i, to_j
        corpus.update(links)
        found.append((len(a), len(b), len(groups), links, digest(";".join(groups).encode())))
    top = defaultdict(int)
    for (_, b), n in corpus.items():
        top[b] = max(top[b], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_groups, links, sha = f
            out.append((n_a, n_b, n_groups, len(links), sum(corpus[p] == top[p[1]] for p in links), sum(corpus[p] for p in links), sha))
    return out


@pytest.mark.parametrize("hot_bytes", [token_alignment.HOT_BYTES, 24 * 40, 0])
def test_alignment_equals_byte_ranges(spark, hot_bytes):
    rows = EDGE + [(10 + k, t, "en") for k, t in enumerate(t for t in strange_texts() if len(t) < 3000)]
    got = token_alignment.alignment(docs_of(spark, rows), *queries.public_sides(), hot_bytes=hot_bytes).collect()
    want = Counter((i, *r) for (i, _, _), r in zip(rows, brute_alignment([t for _, t, _ in rows]), strict=True))
    assert Counter(map(tuple, got)) == want
    assert sum(r.n_a == 0 for r in got) > 5  # some cannot be spelled by both


def test_alignment_over_the_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect() if len(r.text) < 20_000]
    got = token_alignment.alignment(spark.createDataFrame(docs, "doc_id bigint, text string"), *queries.public_sides()).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == dict(zip([i for i, _ in docs], brute_alignment([t for _, t in docs]), strict=True))
    assert queries.op12_token_alignment(spark, sf_dir).count() == table(spark, sf_dir, "documents").count()


def test_alignment_of_long_and_no_texts(spark):
    sides = queries.public_sides()
    assert token_alignment.alignment(docs_of(spark, []), *sides).count() == 0
    r = token_alignment.alignment(docs_of(spark, [(1, "some words " * 150_000, None)]), *sides).first()
    # links are overlaps of two cuts of the same bytes
    assert r.n_links == r.n_a + r.n_b - r.n_groups and r.n_groups > 0


# -- 13

def brute_audit(rows, good, toxic):
    docs = [(i, t or "", la or "") for i, t, la in rows]
    smallest = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t] = min(i, smallest.get(t, i))
    fails = []
    for i, t, _ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails.append({
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > smallest[t],
        })
    out = {}
    for part in {la for *_, la in docs}:
        own = [(f, i in good and i is not None, i in toxic and i is not None) for (i, _, la), f in zip(docs, fails) if la == part]
        removals = Counter()
        for order in itertools.permutations("ABCDE"):
            alive = own
            for step, name in enumerate(order, 1):
                gone = [x for x in alive if x[0][name]]
                alive = [x for x in alive if not x[0][name]]
                removals[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(alive), len(gone), sum(f[name] for f, *_ in own) - len(gone), sum(f[name] and sum(f.values()) == 1 for f, *_ in own),
                    sum(g for _, g, _ in gone), sum(x for *_, x in gone),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(removals[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audit_rows():
    rng = random.Random(3)
    rows = list(EDGE)
    for k in range(120):
        n = rng.choice([0, 3, 199, 200, 201, 400])
        words = [rng.choice(["the", "Cat", "a$b", "X", "ab\tcd", f"w{rng.randint(0, 300)}"]) for _ in range(n)]
        rows.append((rng.choice([k, k, -k, None, 5]), " ".join(words) if n != 3 else "same three words", rng.choice(["en", "de", None, ""])))
    return rows


def test_audit_equals_filters_in_turn(spark):
    rows = audit_rows()
    labels = [(i, q, t) for i, q, t in [(1, 1, 0), (3, 0, 1), (3, 1, None), (5, None, 1), (None, 1, 1), (7, 1, 1), (7, 0, 0), (20, 1, 0), (33, 0, 1), (40, 1, 1)]]
    marked = spark.createDataFrame([(*x, "k") for x in labels], "doc_id bigint, quality int, toxic int, part string")
    want = brute_audit(rows, {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None})
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(docs_of(spark, rows), marked).collect()}
    assert got == want and len(want) == 600 * len({la or "" for *_, la in rows})
    con = duckdb.connect()
    pdf, lab = docs_of(spark, rows).toPandas(), marked.toPandas()
    con.register("documents", pdf.assign(doc_id=pdf["doc_id"].astype("Int64")))
    con.register("labels", lab.astype({c: "Int64" for c in ("doc_id", "quality", "toxic")}))
    named = con.execute(filter_audit.AUDIT_SQL).fetchall()
    assert {r[:3]: r[3:] for r in named} == want
    assert filter_audit.audit(docs_of(spark, []), marked).count() == 0


def test_audit_twin(spark, sf_dir):
    assert differences(queries.op13_filter_audit(spark, sf_dir), connect(sf_dir), filter_audit.AUDIT_SQL) == []


def test_alignment_looks_tokens_up_without_a_key(monkeypatch):
    """Starts are places in the batch, so no lookup by document is needed as well."""
    import pandas as pd

    met, merge = [], pd.merge_asof
    monkeypatch.setattr(pd, "merge_asof", lambda *given, **how: met.append(how) or merge(*given, **how))
    sides = [token_alignment.Side(s) for s in queries.public_sides()]
    texts = ["two documents", "with the same words: two documents", "", "two documents"]
    together = token_alignment.aligned_texts(*sides, texts)
    assert met and all("by" not in how for how in met)
    for name in ("n_a", "n_b", "n_groups", "n_links", "distinct", "groups_sha256"):
        assert [token_alignment.aligned_texts(*sides, [t])[name][0] for t in texts] == list(together[name])
