"""Aggregations (A1-A3).

Values are summed exactly, so a total does not depend on row order (a double
sum does): decimals and integers in their own type and scale, doubles as a
wide decimal named by a parameter. A value that does not fit raises, with
ANSI on or off. Totals of doubles are handed out as ``double`` (the nearest
double to the exact total), totals of other types as they are. An average is
the exact total divided by the count, in double.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What the test tables' double money is cast to in the stand-ins.
MONEY = "decimal(12,2)"
MONEY_SUM = "decimal(38,2)"


# Doubles are summed as this: 18 digits before the point, 10 after it.
WIDE = "decimal(28,10)"


def is_fractional(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DoubleType, T.FloatType))


def exact(df: DataFrame, column: str, wide: str = WIDE) -> Column:
    """``column`` as something whose sum is exact: unchanged for decimals and
    integers, cast to ``wide`` for doubles. A double that does not fit (or NaN
    or infinity) raises."""
    c = F.col(column)
    if not is_fractional(df.schema[column].dataType):
        return c
    cast = c.try_cast(wide)
    return F.when(c.isNotNull() & cast.isNull(),
                  F.raise_error(F.concat(F.lit(f"{column} does not fit {wide}: "), c.cast("string"))).cast(wide)).otherwise(cast)


def handed_out(df: DataFrame, column: str, value: Column) -> Column:
    """An exact value computed from ``column`` in the type users get: double where the column is one."""
    return value.cast("double") if is_fractional(df.schema[column].dataType) else value


def sub_totals(df: DataFrame, group_col: str, value_col: str, prefix: str = "", wide: str = WIDE) -> DataFrame:
    """A1: total, average, smallest and largest value per group, for every
    group at once. NULL values are skipped by every aggregate; ``n_values``
    counts the non-NULL ones. Partial aggregation happens map-side, so a hot
    group costs one row per task in the shuffle."""
    v = exact(df, value_col, wide)
    agg = df.groupBy(group_col).agg(
        F.sum(v).alias("__tot"),
        F.count(v).alias(prefix + "n_values"),
        F.min(v).alias("__min"),
        F.max(v).alias("__max"))
    return agg.select(
        group_col,
        handed_out(df, value_col, F.col("__tot")).alias(prefix + "total"),
        (F.col("__tot").cast("double") / F.nullif(F.col(prefix + "n_values"), F.lit(0))).alias(prefix + "average"),
        handed_out(df, value_col, F.col("__min")).alias(prefix + "smallest"),
        handed_out(df, value_col, F.col("__max")).alias(prefix + "largest"),
        prefix + "n_values")


def filtered_count(df: DataFrame, group_cols: Sequence[str], counted: Column,
                   where: Column | None = None, alias: str = "n") -> DataFrame:
    """A2: COUNT(column) per group over the rows passing ``where``; NULLs of
    ``counted`` are not counted. The filter is a conditional count, so groups
    with no passing row still appear (with 0)."""
    c = counted if where is None else F.when(where, counted)
    return df.groupBy(*group_cols).agg(F.count(c).alias(alias))


def count_with_zero(parents: DataFrame, parent_key: str, children: DataFrame, child_key: str,
                    alias: str = "n") -> DataFrame:
    """A3: number of child rows per parent, parents without children shown
    with 0. Children are counted per key first (map-side combined), then the
    per-key counts (one row per key, however many children it has) are
    joined to the parents."""
    counts = children.groupBy(F.col(child_key).alias("__ck")).agg(F.count(F.lit(1)).alias("__n"))
    return (parents.join(counts, parents[parent_key] == counts["__ck"], "left")
                   .withColumn(alias, F.coalesce(F.col("__n"), F.lit(0)).cast("long"))
                   .drop("__ck", "__n"))
