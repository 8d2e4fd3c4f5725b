"""Cutting texts before single spaces, where no token of the public tokenizers reaches across.

A cut stands before one space between two visible characters. A pre-token of
the byte-level pattern takes a space only at its beginning, or as part of a run
of white space, and a sentence piece holds its space mark only in front: tokens
of the whole text are those of its words, one after the other. Characters that
some library might count as white space are never next to a cut.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: controls, white space, zero-width and format characters of Unicode
HIDDEN = r"\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff"
CUT = rf"(?= [^{HIDDEN}])(?<=[^{HIDDEN}])"
PYTHON_CUT = re.compile(CUT)


def words_of(text: Column) -> Column:
    """The words of ``text`` in order, each with the space before it; an empty text is one empty word."""
    return F.split(text, CUT, -1)


def frequent(counts: DataFrame, n: str, size: Column, max_bytes: int) -> tuple[Column, int, int]:
    """Which rows of ``counts`` are frequent enough to be held together in ``max_bytes``.

    Rows fall into classes by the number of binary digits of ``n``; the frequent ones
    are the top classes whose sizes fit. Gives the condition, how many rows meet
    it, and the most digits of a row that does not (0: all do). At most 64 rows
    come to the driver.
    """
    level = F.length(F.bin(F.col(n)))
    classes = counts.groupBy(level.alias("_level")).agg(F.count(F.lit(1)).alias("_rows"), F.sum(size.cast("long")).alias("_bytes")).collect()
    lowest, used, held, beyond = math.inf, 0, 0, 0
    for row in sorted(classes, key=lambda r: -r["_level"]):
        used += row["_bytes"]
        if used <= max_bytes:
            lowest, held = row["_level"], held + row["_rows"]
        else:
            beyond = max(beyond, row["_level"])
    chosen = F.lit(False) if lowest == math.inf else level >= F.lit(int(lowest))
    return chosen, held, beyond
