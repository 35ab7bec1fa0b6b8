"""Row-wise expressions of the feature pipeline."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Term letter of a presentation code and its season.
TERM_NAMES = {"B": "Spring", "J": "Autumn"}


def rounded(col, digits: int = 6) -> Column:
    """Round for comparison; adding zero turns a negative zero into zero."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def period_year(code) -> Column:
    """Year of a code such as 2013J."""
    return F.substring(code, 1, 4)


def period_term(code) -> Column:
    """Season of a code such as 2013J; NULL for an unknown letter."""
    letter = F.substring(code, 5, 1)
    chain = F.lit(None).cast("string")
    for key, name in TERM_NAMES.items():
        chain = F.when(letter == key, F.lit(name)).otherwise(chain)
    return chain


def row_total(cols: list[str]) -> Column:
    """Sum across columns, missing values count as nothing."""
    return reduce(add, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])


def row_mean(cols: list[str]) -> Column:
    """Mean across the present values of the columns; NULL when all are missing."""
    present = reduce(add, [F.col(c).isNotNull().cast("int") for c in cols])
    return F.when(present > 0, row_total(cols) / present)


def safe_ratio(numerator, denominator) -> Column:
    """Quotient where the denominator is positive, else zero."""
    numerator, denominator = (F.col(c) if isinstance(c, str) else c for c in (numerator, denominator))
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def clip(col, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def text_or_nan(col) -> Column:
    """Text form of a value, the text ``nan`` for a missing one."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.cast("string"), F.lit("nan"))


def binary_label(col, positives: list[str]) -> Column:
    """1 when the value is one of ``positives``, else 0; a missing value is 0."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.isin(*positives), F.lit(False)).cast("int")
