"""Joins (J1-J7).

Join strategy is left to Catalyst and adaptive execution: a side whose
estimated size is under ``spark.sql.autoBroadcastJoinThreshold`` (or whose
shuffled size turns out under the adaptive threshold at runtime) is
broadcast; anything else is a shuffled sort-merge join, with adaptive skew
splitting for a hot key. No join here hints a broadcast of a side that grows
with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.session import require_unique


def join_inner(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner equi-join (the comma-and-WHERE join)."""
    return left.join(right, left[left_key] == right[right_key], "inner")


def join_parent(nodes: DataFrame, node_col: str, parent_col: str,
                parent_columns: Sequence[str], prefix: str = "parent_") -> DataFrame:
    """Left outer self-join of each row to its parent row; the parent's
    ``parent_columns`` come back as ``prefix + name`` (NULL for a root or a
    parent that is not in the table)."""
    parents = nodes.select(F.col(node_col).alias("__parent_key"),
                           *[F.col(c).alias(prefix + c) for c in parent_columns])
    return (nodes.join(parents, nodes[parent_col] == parents["__parent_key"], "left")
                 .drop("__parent_key"))


def join_lookup_default(left: DataFrame, lookup: DataFrame, left_key: str, lookup_key: str,
                        values: dict[str, tuple[str, object]]) -> DataFrame:
    """Optional lookup with a fallback.

    ``values`` maps an output column to (lookup column, fallback). When the
    left key is NULL the fallback is used; when the key is set but has no
    lookup row the value is NULL (not the fallback). A ``lookup`` that holds
    a key twice raises, as a single-row look-up does."""
    require_unique(lookup, [lookup_key], "the look-up")
    lk = "__lookup_key"
    right = lookup.select(F.col(lookup_key).alias(lk), *[F.col(src).alias("__v_" + out)
                                                         for out, (src, _) in values.items()])
    joined = left.join(right, left[left_key] == right[lk], "left")
    for out, (_, fallback) in values.items():
        joined = joined.withColumn(out, F.when(F.col(left_key).isNull(), F.lit(fallback))
                                         .otherwise(F.col("__v_" + out)))
    return joined.drop(lk, *["__v_" + o for o in values])


def join_composite(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on a composite key (all key columns equal, NULL never equal)."""
    return left.join(right, on=list(keys), how=how)


def join_semi(left: DataFrame, right: DataFrame, on: Sequence[str] | Column, negate: bool = False) -> DataFrame:
    """Rows of ``left`` for which a matching ``right`` row EXISTS
    (``negate``: NOT EXISTS). ``right`` is usually pre-filtered."""
    return left.join(right, on=on if isinstance(on, Column) else list(on),
                     how="left_anti" if negate else "left_semi")


def join_anti(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose (non-NULL) key has no parent row."""
    parent_keys = parent.select(F.col(parent_key).alias("__pk"))
    return (child.where(F.col(child_key).isNotNull())
                 .join(parent_keys, F.col(child_key) == F.col("__pk"), "left_anti"))


def join_lateral_explode(df: DataFrame, array_col: str, pos_col: str = "slot",
                         value_col: str = "value", keep_empty: bool = True) -> DataFrame:
    """For each row, the rows of its array (a lateral table function).
    Positions are 1-based. ``keep_empty`` keeps a row (NULL value) for a NULL
    or empty array, like an outer lateral join."""
    rest = [c for c in df.columns if c != array_col]
    # always the outer generator: the plain one gets an inferred
    # ``size(array) > 0`` filter that evaluates an array expression twice
    out = df.select(*rest, F.posexplode_outer(F.col(array_col)).alias("__pos", value_col))
    if not keep_empty:
        out = out.where(F.col("__pos").isNotNull())
    return out.withColumn(pos_col, F.col("__pos") + 1).drop("__pos")
