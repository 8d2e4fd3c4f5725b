"""Document fingerprints by one-permutation MinHash (operator 5), DataFrame functions only.

The hashes of a text's five-word shingles are dealt once into ``BINS`` bins by
their leading bits; each bin keeps its smallest. An empty bin takes the value of
the filled bin that is first in the bin's own random order, which is optimal
densification: the order depends on the two bins alone, so two texts that fill
the same bins borrow from the same one. The low ``BITS`` bits of every bin are
kept, packed; likeness subtracts the matches that short values have by chance.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.llm.common import let

BINS_LOG2 = 7
BINS = 1 << BINS_LOG2
BITS = 8
SHINGLE = 5
CHUNK_ROWS = 2048
MAX_CHUNKS = 1 << 16
BLANKS = r"[\x20\x09-\x0D]+"


def shingles(text: Column, width: int = SHINGLE) -> Column:
    """Hashes of all runs of ``width`` lower-cased words; of the whole sequence where it is shorter; none without words."""
    words = F.array_remove(F.split(F.lower(text), BLANKS), "")
    return let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.when(F.size(h) == 0, F.expr("cast(array() as array<bigint>)"))
        .when(F.size(h) < width, F.array(F.xxhash64(h)))
        .otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - (width - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, width)))),
    )


def bin_of(h: Column) -> Column:
    return F.shiftright(h, 64 - BINS_LOG2)


def minima(hashes: Column) -> Column:
    """The smallest hash of every filled bin, in the order of the bins."""
    return let(
        F.sort_array(hashes),
        lambda s: F.filter(s, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(s, F.greatest(i - 1, F.lit(0)))))),
    )


def densified(low: Column) -> Column:
    """One hash to a bin; empty bins borrow from the filled bin that comes first in their own random order."""
    every = F.sequence(F.lit(-BINS // 2).cast("bigint"), F.lit(BINS // 2 - 1).cast("bigint"))

    def borrowed(b: Column) -> Column:
        order = F.transform(low, lambda h: F.struct(F.xxhash64(b, bin_of(h)).alias("o"), h.alias("h")))
        return F.struct(b.alias("b"), F.array_min(order)["h"].alias("h"))

    filled = F.transform(low, lambda h: F.struct(bin_of(h).alias("b"), h.alias("h")))
    empty = F.transform(F.array_except(every, F.transform(low, bin_of)), borrowed)
    return F.when(F.size(low) == BINS, low).otherwise(F.transform(F.array_sort(F.concat(filled, empty)), lambda x: x["h"]))


def fingerprint(text: Column) -> Column:
    """``BINS`` signed bytes, the low bits of every bin; an empty array for a text without words."""
    sig = let(minima(shingles(text)), lambda low: F.when(F.size(low) == 0, low).otherwise(densified(low)))
    return F.transform(sig, lambda h: (h.bitwiseAND(F.lit((1 << BITS) - 1)) - (1 << (BITS - 1))).cast("tinyint"))


def packed(fp: Column) -> Column:
    """The fingerprint as lowercase hex, two digits to a bin; empty for a text without words."""
    return F.array_join(F.transform(fp, lambda b: F.lower(F.lpad(F.hex(b.cast("bigint") + (1 << (BITS - 1))), 2, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, corrected for chance matches, 0 to 1; two empty ones are alike."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    chance = 1.0 / (1 << BITS)
    estimate = (same / F.lit(float(BINS)) - chance) / (1 - chance)
    either = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(either, (F.size(a) == F.size(b)).cast("double")).otherwise(F.least(F.greatest(estimate, F.lit(0.0)), F.lit(1.0)))


def id_bounds(ids: DataFrame, rows: int, chunk_rows: int = CHUNK_ROWS) -> list[int]:
    """Quantiles of the column ``id``, not null, that cut its ``rows`` rows into ranges of about ``chunk_rows``; at most ``MAX_CHUNKS``.

    An id of many rows comes as often as it holds whole ranges.
    """
    n = max(1, min(MAX_CHUNKS, -(-rows // chunk_rows)))
    if n == 1:
        return []
    shares = F.split(F.lit(",".join(str(k / n) for k in range(1, n))), ",").cast("array<double>")
    return sorted(ids.agg(F.percentile_approx("id", shares, max(10_000, 4 * n)).alias("q")).first()["q"] or [])


def chunk_of(key: Column, salt: Column, bounds: list[int], nulls: int) -> Column:
    """Number of the range of ``key``, which grows with it; null keys take ``nulls`` ranges below zero.

    A key with several ranges of its own is dealt to them by ``salt``, 0 to
    2^63 - 1, greater salts to later ranges. Bounds are looked up in two steps,
    so a row costs the root of their number.
    """

    def spot(count: int) -> Column:
        return F.least(F.floor(salt / F.lit(2.0**63) * count), F.lit(count - 1)).cast("bigint")

    none = spot(max(1, nulls)) - max(1, nulls)
    if not bounds:
        return F.when(key.isNull(), none).otherwise(F.lit(0).cast("bigint"))
    width = math.isqrt(len(bounds) - 1) + 1
    parts = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    text = ";".join(",".join(map(str, part)) for part in parts)
    table = F.transform(F.split(F.lit(text), ";"), lambda part: F.split(part, ",").cast("array<bigint>"))
    firsts = F.split(F.lit(",".join(str(part[0]) for part in parts)), ",").cast("array<bigint>")

    def below(test) -> Column:
        """How many bounds pass ``test``, which holds for a beginning of them."""
        whole = F.size(F.filter(firsts, test))
        return F.when(whole == 0, 0).otherwise((whole - 1) * width + F.size(F.filter(F.get(table, whole - 1), test)))

    def of(ends: Column) -> Column:
        least, most = ends["least"], ends["most"]
        own = most - least
        place = F.least(F.floor(salt / F.lit(2.0**63) * own), own - 1)
        return F.when(own <= 1, most).otherwise(least + 1 + place).cast("bigint")

    ends = F.struct(below(lambda x: x < key).alias("least"), below(lambda x: x <= key).alias("most"))
    return F.when(key.isNull(), none).otherwise(let(ends, of))


def with_next(
    docs: DataFrame, columns: list[str], doc_id: str = "doc_id", derived: dict[str, Column] | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """``docs`` with ``next_<c>`` for each of ``columns``: the row after it by descending id, after the last the first.

    ``derived`` columns are added first, to every row once and again only to
    the first row of each range.

    Ids, whole numbers of up to 64 bits, are cut at their quantiles into at most
    ``MAX_CHUNKS`` ranges of about ``chunk_rows`` rows, however they are spread;
    a range is one sorted window and its last row takes the first row of the
    next range. Rows meet in one shuffle. Equal ids follow each other by
    descending hash of the columns given with ``docs``, and an id of many rows,
    or null, is cut into ranges by that hash; null ids come last. Only rows that
    are equal in all of this share a window whatever their number.
    """
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.count(doc_id).alias("known")).first()
    key = F.col(doc_id).cast("bigint")
    bounds = id_bounds(docs.select(key.alias("id")).where("id is not null"), size["known"], chunk_rows)
    nulls = min(MAX_CHUNKS, -(-(size["n"] - size["known"]) // chunk_rows))
    salt = F.xxhash64(*[c for c in columns if c in docs.columns]).bitwiseAND(F.lit((1 << 63) - 1))
    chunked = docs.withColumn("_salt", salt).withColumn("_chunk", chunk_of(key, F.col("_salt"), bounds, nulls))
    placed = chunked.withColumns(derived or {})
    # at most 2 * MAX_CHUNKS rows: the first row of every range, the one that follows the range before it
    tops = chunked.groupBy("_chunk").agg(F.max(F.struct(F.col(doc_id).alias("id"), F.col("_salt").alias("salt"))).alias("_top"))
    ring = Window.orderBy(F.col("_chunk").desc())
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tops.select(F.col("_chunk").alias("_own"), "_top", F.coalesce(F.lag("_chunk").over(ring), F.last("_chunk").over(whole)).alias("_before"))
    is_first = F.col(doc_id).eqNullSafe(F.col("_top")["id"]) & (F.col("_salt") == F.col("_top")["salt"])
    firsts = chunked.join(F.broadcast(tops), (F.col("_chunk") == F.col("_own")) & is_first)
    firsts = firsts.withColumns(derived or {})
    heads = firsts.groupBy("_before").agg(F.min(F.struct(*columns)).alias("_head")).select(F.col("_before").alias("_chunk"), "_head")
    within = Window.partitionBy("_chunk").orderBy(F.col(doc_id).desc_nulls_last(), F.col("_salt").desc(), *columns)
    following = F.lead(F.struct(*columns)).over(within)
    joined = placed.withColumn("_next", following).join(heads, "_chunk", "left")
    after = F.coalesce("_next", "_head")
    return joined.select(*docs.columns, *(derived or {}), *[after[c].alias(f"next_{c}") for c in columns])


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of each whole text and of its edited text, and their likeness; see the query's contract.

    The edited text has its last ``floor(n_chars / 2)`` code points replaced by
    the first as many of the next document. A null text counts as empty: no
    words, empty fingerprint, like another empty one and unlike the rest. One
    document alone follows itself. Rows with equal or null ids stay; other
    columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    both = with_next(rows, ["t", "fp"], derived={"fp": fingerprint(F.col("t"))})
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    both = both.withColumn("edited", F.concat(F.substring("t", F.lit(1), n - half), F.substring("next_t", F.lit(1), half)))
    both = both.select("doc_id", n.cast("bigint").alias("n_chars"), "edited", "fp", "next_fp")
    both = both.withColumn("efp", fingerprint(F.col("edited")))
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed(F.col("fp")).alias("fingerprint"),
        packed(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
