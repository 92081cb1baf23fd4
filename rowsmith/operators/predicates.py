"""Projections and filters.

All of these are plain Column predicates: Catalyst pushes the simple ones
(equality, ranges, IN lists, IS NULL, prefix) into the Parquet scan and keeps
the rest inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.session import require_unique


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def project(df: DataFrame, columns: Sequence[str | Column]) -> DataFrame:
    """keep and reorder columns."""
    return df.select(*columns)


def filter_eq(df: DataFrame, column: str | Column, value) -> DataFrame:
    """``column = value`` (NULL never matches)."""
    return df.where(col(column) == F.lit(value))


def filter_key_set(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """F2 for a set of parameter values held in a DataFrame: a semi join, so the
    key set may be of any size (Catalyst broadcasts it when small)."""
    return df.join(keys, on=on, how="left_semi")


def filter_range(df: DataFrame, column: str | Column, lower=None, upper=None,
                 lower_inclusive: bool = True, upper_inclusive: bool = False) -> DataFrame:
    """one- or two-sided range; each bound may be omitted."""
    c, cond = col(column), F.lit(True)
    if lower is not None:
        cond = cond & ((c >= F.lit(lower)) if lower_inclusive else (c > F.lit(lower)))
    if upper is not None:
        cond = cond & ((c <= F.lit(upper)) if upper_inclusive else (c < F.lit(upper)))
    return df.where(cond)


def filter_between(df: DataFrame, column: str | Column, low, high) -> DataFrame:
    """closed interval on both ends."""
    return df.where(col(column).between(F.lit(low), F.lit(high)))


def in_list(column: str | Column, values: Iterable) -> Column:
    return col(column).isin(list(values))


def not_in_list(column: str | Column, values: Iterable) -> Column:
    """SQL ``NOT IN``: unknown when the value is NULL or the list holds NULL,
    so such rows are not kept by a filter."""
    return ~col(column).isin(list(values))


def filter_in_list(df: DataFrame, column: str | Column, values: Iterable, negate: bool = False) -> DataFrame:
    """IN / NOT IN a value list."""
    return df.where(not_in_list(column, values) if negate else in_list(column, values))


def is_true(pred: Column) -> Column:
    """Three-valued logic made explicit: only TRUE counts (NULL -> False)."""
    return F.coalesce(pred, F.lit(False))


def is_not_false(pred: Column) -> Column:
    """CHECK semantics: only FALSE violates, unknown passes."""
    return F.coalesce(pred, F.lit(True))


def filter_null(df: DataFrame, column: str | Column, is_null: bool = True) -> DataFrame:
    """IS NULL / IS NOT NULL."""
    c = col(column)
    return df.where(c.isNull() if is_null else c.isNotNull())


def filter_prefix(df: DataFrame, column: str | Column, prefix: str) -> DataFrame:
    """STARTING WITH (case-sensitive; pushed to Parquet as a string prefix)."""
    return df.where(col(column).startswith(prefix))


def filter_where(df: DataFrame, predicate: Column) -> DataFrame:
    """F8: any AND / OR / NOT composition; rows where it is TRUE are kept."""
    return df.where(predicate)


def scalar_lookup(df: DataFrame, lookup: DataFrame, keys: Sequence[str],
                  values: Sequence[str], known_unique: bool = False) -> DataFrame:
    """correlated scalar subquery on a (composite) key, decorrelated as a
    left join. A ``lookup`` that holds a key twice raises (as a scalar subquery
    that returns two rows does); rows with no match get NULL. The test costs a
    job unless the look-up is ``known_unique`` (``session.stored_lookup``)."""
    if not known_unique:
        require_unique(lookup, list(keys), "the look-up")
    return df.join(lookup.select(*keys, *values), on=list(keys), how="left")
