"""Integrity checks as jobs (C1-C10): each returns the offending rows, or one
count row per rule.

A rule is a Column predicate that is TRUE for a good row. As in SQL CHECK
constraints, only FALSE violates: a rule that evaluates to NULL (unknown)
passes, and is counted apart as ``n_unknown``. Many rules over one table are
evaluated in one scan (one aggregate, or one generator for the offending
rows), never one job per rule.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    predicate: Column  # TRUE for a good row


def violated(pred: Column) -> Column:
    """FALSE -> True; TRUE or unknown -> False."""
    return ~F.coalesce(pred, F.lit(True))


def unknown(pred: Column) -> Column:
    return pred.isNull()


def rule_counts(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """C7 (counts): one row per rule, (rule, n_violations, n_unknown), from a
    single aggregation pass over ``df``."""
    aggs = []
    for i, r in enumerate(rules):
        aggs.append(F.count(F.when(violated(r.predicate), 1)).alias(f"__v{i}"))
        aggs.append(F.count(F.when(unknown(r.predicate), 1)).alias(f"__u{i}"))
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"__v{i}").alias("n_violations"),
                              F.col(f"__u{i}").alias("n_unknown")) for i, r in enumerate(rules)])
    return one.select(F.inline(rows))


def violations(df: DataFrame, rules: Sequence[Rule], keep: Sequence[str]) -> DataFrame:
    """C7/C8 (rows): (keep..., rule) for every row and every rule it violates,
    in one pass (a row failing two rules appears twice)."""
    failing = F.array_compact(F.array(*[F.when(violated(r.predicate), F.lit(r.name)) for r in rules]))
    # the outer generator gets no inferred ``size(..) > 0`` filter, which would
    # evaluate every rule twice; its NULL row for a clean row is dropped here
    return df.select(*keep, F.explode_outer(failing).alias("rule")).where(F.col("rule").isNotNull())


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NOT NULL per column, one pass: (column_name, n_null)."""
    one = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(f"__n{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"__n{i}").alias("n_null"))
                     for i, c in enumerate(columns)])
    return one.select(F.inline(rows))


def duplicate_keys(df: DataFrame, keys: Sequence[str], null_is_distinct: bool = False) -> DataFrame:
    """Key values held by more than one row, with ``n_rows``.

    Primary key (C2): a NULL key part is a value like any other here (the
    NOT NULL check reports it). UNIQUE (C3, ``null_is_distinct``): a key
    with a NULL part never collides. The count is map-side combined, so a key
    shared by a third of the table is one partial count per task."""
    src = df
    if null_is_distinct:
        cond = F.lit(True)
        for k in keys:
            cond = cond & F.col(k).isNotNull()
        src = df.where(cond)
    return (src.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
               .where(F.col("n_rows") > 1))


def orphans(child: DataFrame, child_keys: Sequence[str], parent: DataFrame,
            parent_keys: Sequence[str]) -> DataFrame:
    """Child rows whose foreign key has no parent row. A key with
    any NULL part is not checked (MATCH SIMPLE). The parent keys go into the
    anti join as they are: repeats do no harm there, and without an aggregate
    under the join adaptive execution can split a hot key."""
    cond = F.lit(True)
    for k in child_keys:
        cond = cond & F.col(k).isNotNull()
    pk = parent.select(*[F.col(p).alias(f"__pk{i}") for i, p in enumerate(parent_keys)])
    on = None
    for i, k in enumerate(child_keys):
        e = F.col(k) == F.col(f"__pk{i}")
        on = e if on is None else on & e
    return child.where(cond).join(pk, on, "left_anti")


def self_reference(nodes: DataFrame, node_col: str, parent_col: str) -> DataFrame:
    """A parent link inside one table. Returns (node, parent, status)
    with status ``missing_parent`` (the parent key names no row) or ``root``
    (no parent at all, the top of a tree). Every other row is fine."""
    keys = nodes.select(F.col(node_col).alias("__pk"))
    missing = (nodes.where(F.col(parent_col).isNotNull())
                    .join(keys, F.col(parent_col) == F.col("__pk"), "left_anti")
                    .select(node_col, parent_col, F.lit("missing_parent").alias("status")))
    roots = nodes.where(F.col(parent_col).isNull()).select(node_col, parent_col, F.lit("root").alias("status"))
    return missing.unionByName(roots)


def range_violations(df: DataFrame, ranges: DataFrame, keys: Sequence[str], value: str,
                     low: str, high: str) -> DataFrame:
    """``value`` must lie in [low, high] of the ``ranges`` row with the
    same composite key. No range row -> unknown -> not a violation. Returns
    the offending rows of ``df`` with ``low`` and ``high``."""
    r = ranges.select(*keys, low, high)
    joined = df.join(r, on=list(keys), how="inner")
    return joined.where(violated(F.col(value).between(F.col(low), F.col(high))))


def cross_table(df: DataFrame, condition: Column, other: DataFrame, other_condition: Column,
                on: Sequence[str] | Column) -> DataFrame:
    """``CHECK (NOT (condition AND EXISTS (other row matching and
    other_condition)))``: the rows of ``df`` that break it."""
    flagged = other.where(other_condition)
    return df.where(F.coalesce(condition, F.lit(False))).join(
        flagged, on=on if isinstance(on, Column) else list(on), how="left_semi")
