"""Words of a text: runs of characters other than space and the ASCII controls 9 to 13."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that part words.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; a missing text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def word_list(text: Column) -> Column:
    """The words in order; a missing text gives an empty array."""
    spaced = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.array_remove(F.split(spaced, " "), "")


def word_bytes(text: str | None) -> list[bytes]:
    """The words as UTF-8, for Python workers: ``bytes.split`` parts at the same six characters."""
    return (text or "").encode("utf-8", "surrogatepass").split()
