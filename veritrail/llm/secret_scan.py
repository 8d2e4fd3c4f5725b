"""Secret scans with corpus-wide ownership frequency (operator 6), DataFrame functions only.

Patterns find candidates with their places. The hash of each candidate's value
is counted over the whole corpus by distinct owners and repositories: a value
under many owners or in many repositories is a copied example, one under a
single owner and in few repositories that also looks random is a live credential. The patterns' own spans always stay; beyond them,
long tokens that no pattern names become spans where ownership marks them live.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import let
from veritrail.session import written_table

# fixed values: the base patterns
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ASSIGN_MIN, ACCESS_MIN = 6, 20

TOKEN = r"[A-Za-z0-9+/_-]{32,}"
EXAMPLE_OWNERS = 3
EXAMPLE_REPOS = 16
# a random token: its pieces between separators change class often, read unlike words and have so many characters in all
PIECE = r"[A-Za-z0-9]{5,}"
SWITCH = r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
WORDLIKE = r"[A-Z][a-z]{2,}|[a-z]{4,}"
UUID = r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"
RANDOM_CHARS, SWITCH_SHARE, WORD_SHARE, ENTROPY = 20, 0.2, 0.5, 3.0
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|x{6}|0{6}|1234567"
KINDS = ("assign", "access", "hex", "token")
SPAN = "struct<start:bigint,ord:int,end:bigint,value:string>"
NO_SPANS = f"cast(array() as array<{SPAN}>)"
CHUNK = 512


def walk(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], empty: str, end: Callable[[Column], Column]) -> Column:
    """``step(carry, item) -> (carry, outputs)`` over ``items`` in order; ``end`` takes the last carry and all outputs.

    Items go by chunks, so that only a chunk's outputs are copied at each step
    and time grows with the number of items rather than its square. ``empty`` is
    the SQL of an empty array of outputs.
    """

    def state(carry: Column, out: Column) -> Column:
        return F.struct(carry.alias("carry"), out.alias("out"))

    def one(acc: Column, item: Column) -> Column:
        carry, outputs = step(acc["carry"], item)
        return state(carry, F.concat(acc["out"], outputs))

    def chunk(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, state(acc["carry"], F.expr(empty)), one)
        return let(done, lambda d: state(d["carry"], F.concat(acc["out"], F.array(d["out"]))))

    firsts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(CHUNK))
    parts = F.transform(firsts, lambda i: F.slice(items, i, CHUNK))
    whole = F.aggregate(parts, state(start, F.filter(F.array(F.expr(empty)), lambda _: F.lit(False))), chunk)
    return let(whole, lambda w: end(F.struct(w["carry"].alias("carry"), F.flatten(w["out"]).alias("out"))))


def _spans(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """All leftmost matches with code point places, in order; ``value`` is the match or its group.

    Java's split and its search walk the same matches, so the pieces between
    them give the places.
    """

    def step(at: Column, m: Column) -> tuple[Column, Column]:
        start = at + F.length(m["piece"])
        end = start + F.length(m["match"])
        return end, F.array(F.struct(start.alias("start"), F.lit(kind).alias("ord"), end.alias("end"), m["value"].alias("value")))

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.zip_with(
        F.arrays_zip(matches.alias("match"), values.alias("value")), F.split(text, pattern, -1),
        lambda m, piece: F.struct(m["match"].alias("match"), m["value"].alias("value"), piece.alias("piece")),
    )
    # the last piece has no match after it
    found = let(
        F.filter(rows, lambda m: m["match"].isNotNull()),
        lambda ms: walk(ms, F.lit(0).cast("bigint"), step, NO_SPANS, lambda done: done["out"]),
    )
    return F.when(text.rlike(pattern), found).otherwise(F.expr(NO_SPANS))


def _apart(spans: Column, base: Column, kind: int) -> Column:
    """The ``spans`` of ``kind`` that overlap none of ``base``, by one walk in the order of places and one back."""

    def kept(s: Column, free: Column) -> Column:
        return F.when((s["ord"] != kind) | free, F.array(s)).otherwise(F.expr(NO_SPANS))

    def forth(reach: Column, s: Column) -> tuple[Column, Column]:
        return F.when(s["ord"] != kind, F.greatest(reach, s["end"])).otherwise(reach), kept(s, reach <= s["start"])

    def back(reach: Column, s: Column) -> tuple[Column, Column]:
        return F.when(s["ord"] != kind, F.least(reach, s["start"])).otherwise(reach), kept(s, reach >= s["end"])

    # of equal starts the base comes first
    left = let(F.array_sort(F.concat(base, spans)), lambda a: walk(a, F.lit(0).cast("bigint"), forth, NO_SPANS, lambda done: done["out"]))
    both = let(F.reverse(left), lambda a: walk(a, F.lit((1 << 63) - 1), back, NO_SPANS, lambda done: done["out"]))
    own = F.filter(F.reverse(both), lambda s: s["ord"] == kind)
    return F.when((F.size(spans) > 0) & (F.size(base) > 0), own).otherwise(spans)


def scan(docs: DataFrame, doc_id: str, text: str, owner: str, repo: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, owner, repo, base, extra, tkey``: spans by place and the text's hash where it has any.

    One pass over the texts without a shuffle; texts themselves are not kept.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repo).cast("string").alias("repo"),
        whole.alias("t"), *carry,
    )
    rows = rows.withColumns({
        "a": F.filter(_spans(F.col("t"), ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= ASSIGN_MIN),
        "k": F.filter(_spans(F.col("t"), ACCESS, 1), lambda s: F.length(s["value"]) >= ACCESS_MIN),
        "h": _spans(F.col("t"), HEX, 2),
        "g": _spans(F.col("t"), TOKEN, 3),
    })
    base = F.array_sort(F.concat("a", "k", "h"))
    rows = rows.withColumn("base", base).withColumn("extra", _apart(F.col("g"), F.col("base"), 3))
    some = (F.size("base") > 0) | (F.size("extra") > 0)
    return rows.select(
        "doc_id", "owner", "repo", F.size("a").cast("bigint").alias("n_assign"), F.size("k").cast("bigint").alias("n_access"),
        F.size("h").cast("bigint").alias("n_hex"), "base", "extra", F.when(some, F.sha2("t", 256)).alias("tkey"), *carry,
    )


def looks_live(value: Column) -> Column:
    """Random-looking: 16 characters or more, letters and digits, many distinct characters, no placeholder word."""
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return (F.length(value) >= 16) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (distinct >= 8) & ~value.rlike(PLACEHOLDER)


def entropy(value: Column) -> Column:
    """Bits to a character, by the characters' shares in ``value`` itself."""

    def of(chars: Column) -> Column:
        def term(c: Column) -> Column:
            share = F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
            return -share * F.log2(share)

        return F.aggregate(F.transform(F.array_distinct(chars), term), F.lit(0.0), lambda acc, x: acc + x)

    return let(F.split(value, ""), of)


def looks_random(value: Column) -> Column:
    """A live token that no pattern names: most of it is random, as URL paths, slugs, file names and identifiers are not.

    Only pieces between separators count in which lower case, capitals and
    digits alternate (a capital that starts a word is no change) and at most
    half of which reads like words; UUIDs name things and do not count.
    """

    def wordlike(run: Column) -> Column:
        return run.rlike("(?i)[aeiouy]") & ~run.rlike("(?i)[^aeiouy]{4}")

    def random_piece(piece: Column) -> Column:
        switches = F.size(F.regexp_extract_all(piece, F.lit(SWITCH), F.lit(0)))
        words = F.filter(F.regexp_extract_all(piece, F.lit(WORDLIKE), F.lit(0)), wordlike)
        return (switches >= SWITCH_SHARE * (F.length(piece) - 1)) & (F.length(F.array_join(words, "")) <= WORD_SHARE * F.length(piece))

    pieces = F.filter(F.regexp_extract_all(F.regexp_replace(value, UUID, "/"), F.lit(PIECE), F.lit(0)), random_piece)
    return let(F.array_join(pieces, ""), lambda v: (F.length(v) >= RANDOM_CHARS) & looks_live(v) & (entropy(v) >= ENTROPY)) & looks_live(value)


def ownership(scanned: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """``vhash, owners, repos, verdict`` of every candidate value of the corpus.

    ``example``: under ``example_owners`` owners or more, or in ``example_repos``
    repositories or more. ``live``: neither, under one owner and random-looking,
    by the stricter ``looks_random`` where no pattern names it. ``unsure``: the rest. A null owner or repository counts as one of its own.
    Copies of one text count as one repository, the first by name, so copying a
    whole text does not make its secrets examples. Counting starts with distinct
    triples, so that a value copied a million times arrives as few rows.
    """
    values = scanned.where("tkey is not null").select("owner", "repo", "tkey", F.explode(F.concat("base", "extra")).alias("span"))
    value = F.col("span")["value"]
    live = F.when(F.col("span")["ord"] == KINDS.index("token"), looks_random(value)).otherwise(looks_live(value))
    triples = values.select(
        F.sha2(value, 256).alias("vhash"), live.alias("live"), "tkey",
        F.coalesce(F.concat(F.lit("+"), "owner"), F.lit("-")).alias("owner"), F.coalesce(F.concat(F.lit("+"), "repo"), F.lit("-")).alias("repo"),
    ).groupBy("vhash", "owner", "tkey").agg(F.max("live").alias("live"), F.min("repo").alias("repo"))
    by_owner = triples.groupBy("vhash", "owner").agg(F.max("live").alias("live"))
    owners = by_owner.groupBy("vhash").agg(F.max("live").alias("live"), F.count(F.lit(1)).alias("owners"))
    by_text = triples.groupBy("vhash", "tkey").agg(F.min("repo").alias("repo"))
    repos = by_text.select("vhash", "repo").distinct().groupBy("vhash").agg(F.count(F.lit(1)).alias("repos"))
    many = (F.col("owners") >= example_owners) | (F.col("repos") >= example_repos)
    verdict = F.when(many, "example").when((F.col("owners") == 1) & F.col("live"), "live").otherwise("unsure")
    return owners.join(repos, "vhash").select("vhash", "owners", "repos", verdict.alias("verdict"))


def judged(scanned: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """``tkey, base, added, n_live, n_example`` of every distinct text that holds a candidate.

    ``added`` are its live spans beyond the base, the counts go over both. Copies
    of a text share one row here, so a text with a third of all rows costs no
    more than another, and each span meets its verdict by a join on the value.
    """
    verdicts = ownership(scanned, example_owners).select("vhash", "verdict")
    texts = scanned.where("tkey is not null").select("tkey", "base", "extra").dropDuplicates(["tkey"])
    spans = texts.select("tkey", F.explode(F.concat("base", "extra")).alias("span"))
    # places only: the value has done its work once it is hashed
    place = F.col("span").withField("value", F.lit(None).cast("string"))
    found = spans.select("tkey", F.sha2(F.col("span")["value"], 256).alias("vhash"), place.alias("span")).join(verdicts, "vhash")
    named, live = F.col("span")["ord"] != KINDS.index("token"), F.col("verdict") == "live"
    return found.groupBy("tkey").agg(
        F.array_sort(F.collect_list(F.when(named, F.col("span")))).alias("base"),
        F.array_sort(F.collect_list(F.when(~named & live, F.col("span")))).alias("added"),
        F.count_if(live).alias("n_live"), F.count_if(named & (F.col("verdict") == "example")).alias("n_example"),
    )


def with_verdicts(scanned: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """``scanned`` with ``added`` (live spans beyond the base) and ``n_live, n_example`` over all spans."""
    zero = F.lit(0).cast("bigint")
    clean = scanned.where("tkey is null").withColumns({"added": F.expr(NO_SPANS), "n_live": zero, "n_example": zero})
    found = scanned.where("tkey is not null").join(judged(scanned, example_owners).drop("base"), "tkey")
    return clean.unionByName(found.select(*clean.columns))


def written(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(name, s["ord"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def find_secrets(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "doc_id", example_owners: int = EXAMPLE_OWNERS
) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example`` of every row.

    Spans are whole matches in code points, end exclusive. A null text counts as
    empty and has no spans. Null ids and owners stay, repeated rows stay, other
    columns are not read; an empty table gives an empty result.
    """
    scanned = written_table(scan(docs, doc_id, text, owner, repo), "secrets")
    return with_verdicts(scanned, example_owners).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "added"))).alias("spans"), "n_live", "n_example",
    )


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with the union of ``spans`` replaced, each stretch by one mask."""

    def inside(at: Column, stretch: Column, part: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            gap = F.substring(stretch, (acc["at"] - at + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
            piece = F.when(s["start"] >= acc["at"], F.concat(gap, F.lit(mask))).otherwise(F.lit(""))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

        return F.aggregate(part, F.struct(at.alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

    def chunk(acc: Column, part: Column) -> Column:
        # places count from the start of a string, so a chunk of spans reads its own stretch of the text only
        end = F.greatest(acc["at"], F.array_max(F.transform(part, lambda s: s["end"])))
        size = (end - acc["at"]).cast("int")
        done = inside(acc["at"], F.substring(acc["rest"], F.lit(1), size), part)
        rest = F.substring(acc["rest"], size + 1, F.length(acc["rest"]))
        return F.struct(end.alias("at"), rest.alias("rest"), F.concat(acc["out"], F.array(done)).alias("out"))

    def cut(ordered: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(ordered), F.lit(1)), F.lit(CHUNK))
        parts = F.transform(firsts, lambda i: F.slice(ordered, i, CHUNK))
        start = F.struct(F.lit(0).cast("bigint").alias("at"), text.alias("rest"), F.expr("cast(array() as array<string>)").alias("out"))
        return F.aggregate(parts, start, chunk, lambda acc: F.concat(F.array_join(acc["out"], ""), acc["rest"]))

    return F.when(F.size(spans) > 0, let(F.array_sort(spans), cut)).otherwise(text)


def mask_secrets(docs: DataFrame, text: str = "text", owner: str = "source", repo: str = "doc_id", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with every base span, and every added live one, masked in its text and ``n_chars`` brought up to date.

    No row goes: a text without secrets is left as it is. Texts that hold a
    candidate meet their verdicts by the hash of the text. All other columns,
    whatever their names, are handed on.
    """
    scanned = written_table(scan(docs, "doc_id", text, owner, repo), "secrets")
    spans = judged(scanned).select("tkey", F.concat("base", "added").alias("_spans")).where(F.size("_spans") > 0)
    spans = written_table(spans, "secrets-spans")
    hit = F.col(text).rlike(ASSIGN) | F.col(text).rlike(ACCESS) | F.col(text).rlike(HEX) | F.col(text).rlike(TOKEN)
    clean = docs.where(~F.coalesce(hit, F.lit(False)))
    rows = docs.where(hit).select(F.sha2(F.col(text), 256).alias("tkey"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = rows.join(spans, "tkey", "left")
    new = masked(F.col("row")[text], F.coalesce("_spans", F.expr(NO_SPANS)))
    found = found.select("row", "_spans", new.alias("masked"))
    fields = {c: F.col("row")[c] for c in docs.columns} | {text: F.col("masked")}
    if n_chars in docs.columns:
        length = F.when(F.col("_spans").isNotNull(), F.length("masked")).otherwise(F.col("row")[n_chars])
        fields[n_chars] = length.cast(docs.schema[n_chars].dataType)
    return clean.unionByName(found.select(*[value.alias(c) for c, value in fields.items()]))
