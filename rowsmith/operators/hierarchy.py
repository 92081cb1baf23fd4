"""Parent-child trees held as (node, parent) rows: rollup (A4).

The rollup never builds the (node, ancestor) closure, which has n x depth
rows, and does not walk one level per round either (depth rounds, and n x
depth rows in total on a long chain). It doubles the reach of every node per
round instead (pointer jumping):

    T_0(a)   = own value of a
    J_0(b)   = parent of b
    T_j+1(a) = T_j(a) + sum of T_j(b) over the nodes b with J_j(b) = a
    J_j+1(b) = J_j(J_j(b))

``T_j(a)`` sums the descendants of ``a`` less than 2^j levels below it and
``J_j(b)`` is the ancestor 2^j levels above ``b``; a descendant d between 2^j
and 2^(j+1) levels below ``a`` is counted once, through the one node b on the
path with J_j(b) = a. When ``J`` is empty every node has its total:
log2(depth) + 1 rounds of O(n) work each.

``T`` and ``J`` live on the same row (node, partial totals, pointer), so a
round is: a ``groupBy`` of the contributions by pointer (map-side partial
aggregation, so a node with a huge number of descendants at one distance
costs one row per task in the shuffle), a join of them back on the node, and
a self-join that moves the pointer up (the pointer of the row it points at).
The round's table is written with a reliable ``checkpoint()`` to the shared
checkpoint folder: the logical plan stays flat (each round reads the last
one three times, so an unchecked plan would triple per round) and a lost
executor re-reads the last round. The number of rows still pointing
somewhere, the stop test, is an ``Observation`` collected by that same
checkpoint job. On a cycle pointers never run out; the loop stops with an
error once the reach passes the number of nodes.

Rows whose pointer has run out skip the pointer join: only live rows move up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rowsmith.operators.aggregates import WIDE, exact, handed_out
from rowsmith.session import checkpoint_root, key_counts

_MEASURES = ("__sum", "__vals", "__nulls", "__nodes")


class TreeDepthError(ValueError):
    """The parent links hold a cycle, or the tree is deeper than allowed."""


def _observed_checkpoint(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Checkpoint ``df``; also return how many rows still have a pointer."""
    seen = Observation(name)
    out = df.observe(seen, F.count(F.col("__anc")).alias("active")).checkpoint(eager=True)
    return out, seen.get["active"]


def tree_rollup(nodes: DataFrame, node_col: str, parent_col: str, value_col: str,
                max_depth: int | None = None, wide: str = WIDE) -> DataFrame:
    """A4: for every node, its own value plus the values of all descendants.

    Output: ``node_col``, ``own_value``, ``subtree_total`` (NULL values count
    as 0), ``subtree_values`` (non-NULL values in the subtree),
    ``subtree_nodes`` (nodes in the subtree, itself included), ``has_null``
    (some value in the subtree is NULL). Values are summed exactly (see
    ``aggregates.exact``). A node whose parent is not in the table is the top
    of its own tree. A node held twice raises. ``max_depth`` defaults to the
    number of nodes: pointers still live beyond it mean a cycle.
    """
    checkpoint_root(nodes.sparkSession)
    n, most = key_counts(nodes, [node_col])
    if most > 1:
        raise ValueError(f"the tree holds a key more than once: {node_col}")
    if max_depth is None:
        max_depth = max(1, n)
    v = exact(nodes, value_col, wide)
    total = nodes.agg(F.sum(v).alias("t")).schema["t"].dataType
    state = nodes.select(  # round 0: read straight from the scan, no write
        F.col(node_col).alias("__node"),
        F.coalesce(v.cast(total), F.lit(0).cast(total)).alias("__sum"),
        F.when(v.isNotNull(), 1).otherwise(0).cast("long").alias("__vals"),
        F.when(v.isNull(), 1).otherwise(0).cast("long").alias("__nulls"),
        F.lit(1).cast("long").alias("__nodes"),
        F.col(parent_col).alias("__anc"))

    reach, rnd = 1, 0
    while True:
        if reach > max_depth:
            raise TreeDepthError(f"parent links deeper than {max_depth} levels (a cycle?)")
        rnd += 1
        # every node hands its partial total to the node 2^j above it
        contrib = (state.where(F.col("__anc").isNotNull())
                        .groupBy(F.col("__anc").alias("__node"))
                        .agg(*[F.sum(m).alias("__c" + m) for m in _MEASURES]))
        # and its pointer doubles: the pointer of the node it points at
        up = state.select(F.col("__node").alias("__mid"), F.col("__anc").alias("__up"))
        added = state.join(contrib, "__node", "left").select(
            "__node", *[(F.col(m) + F.coalesce(F.col("__c" + m), F.lit(0))).alias(m) for m in _MEASURES], "__anc") \
            .withColumn("__sum", F.col("__sum").cast(total))
        nxt = (added.where(F.col("__anc").isNotNull()).join(up, F.col("__anc") == F.col("__mid"), "left")
                    .select("__node", *_MEASURES, F.col("__up").alias("__anc"))
                    .unionByName(added.where(F.col("__anc").isNull())))
        state, active = _observed_checkpoint(nxt, f"tree_rollup_round_{rnd}")
        if active == 0:
            break
        reach *= 2

    own = nodes.select(F.col(node_col), handed_out(nodes, value_col, v).alias("own_value"))
    return (own.join(state, own[node_col] == state["__node"], "inner")
               .select(node_col, "own_value",
                       handed_out(nodes, value_col, F.col("__sum")).alias("subtree_total"),
                       F.col("__vals").alias("subtree_values"),
                       F.col("__nodes").alias("subtree_nodes"),
                       (F.col("__nulls") > 0).alias("has_null")))
