"""Joins that hot keys cannot stop.

Adaptive execution splits a hot key only where the join reads a plain shuffle:
an aggregate, a window or another join right under it keeps all rows of the
key in one task. The joins here measure the hot keys first and take their rows
past the shuffle.

A key is hot when it holds more than ``share`` of the rows and more than
``HOT_ROWS`` of them. There can be at most 1 / ``share`` such keys, whatever
the input, so the hot keys, and the one row each of them has on a side with
unique keys, are broadcast within a proven bound. The rows of a hot key stay
in the tasks that read them; all others meet in an ordinary shuffled join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

#: A key with fewer rows than this is never hot: any task handles them.
HOT_ROWS = 10_000
#: A key with a smaller share of the rows is never hot.
HOT_SHARE = 0.001


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE) -> DataFrame | None:
    """The hot keys of ``df`` (at most 1 / ``share`` rows, marked for broadcast), or None.

    One job: a map-side combined count per key, of which the largest 1 / ``share`` come to the driver together with
    the total. Keys with a NULL part match nothing in an equality join and are not counted.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    total = Observation()
    counts = (df.select(*keys).dropna().groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
              .observe(total, F.sum("__n").alias("rows")))
    top = counts.orderBy(F.desc("__n")).limit(int(1 / share)).collect()
    limit = max(HOT_ROWS, share * (total.get["rows"] or 0))
    hot = [tuple(r)[:-1] for r in top if r["__n"] > limit]
    if not hot:
        return None
    return F.broadcast(df.sparkSession.createDataFrame(hot, df.select(*keys).schema))


def hot_of(counts: DataFrame, keys: list[str], n: str, share: float = HOT_SHARE) -> DataFrame | None:
    """``hot_keys`` from counts that are known already: the at most 1 / ``share`` largest with more than ``HOT_ROWS`` in column ``n``."""
    top = counts.where(F.col(n) > HOT_ROWS).orderBy(F.desc(n)).limit(int(1 / share)).select(*keys).collect()
    return F.broadcast(counts.sparkSession.createDataFrame(top, counts.select(*keys).schema)) if top else None


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner",
                share: float = HOT_SHARE, counts: tuple[DataFrame, str] | None = None, nulls_apart: bool = False) -> DataFrame:
    """``left`` joined with ``right``, which holds no key twice, on equal ``keys``.

    ``how`` is inner, left, left_semi or left_anti. Rows of hot keys of ``left`` meet a broadcast of the right side's
    rows of those keys (at most one a key), all others a shuffled join. ``left`` is read twice, and once more for its
    keys unless ``counts``, a stored frame of its keys and the name of their count, tells the hot ones; so it should be a scan or a stored table.
    With ``nulls_apart`` rows with a NULL in their key, which match nothing, are not shuffled to one task but pass by the join.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"join_unique does not do {how} joins")
    if nulls_apart:
        whole = left.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
        joined = join_unique(whole, right, keys, how, share, counts)
        if how in ("inner", "left_semi"):
            return joined
        return joined.unionByName(left.where(" OR ".join(f"`{k}` IS NULL" for k in keys)), allowMissingColumns=True)
    hot = hot_keys(left, keys, share) if counts is None else hot_of(counts[0], keys, counts[1], share)
    if hot is None:
        return left.join(right, keys, how)
    few = F.broadcast(right.join(hot, keys, "left_semi"))
    return (left.join(hot, keys, "left_semi").join(few, keys, how)
            .unionByName(left.join(hot, keys, "left_anti").join(right, keys, how)))


def split_by_keys(left: DataFrame, right: DataFrame, keys: list[str],
                  share: float = HOT_SHARE) -> tuple[DataFrame, DataFrame]:
    """(rows of ``left`` whose key is in ``right``, the other ones, NULL keys included), by ``join_unique``'s rules.

    ``right`` has the columns ``keys``; a key held there several times does no harm. The hot keys are measured once for both parts.
    """
    whole = left.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    apart = left.where(" OR ".join(f"`{k}` IS NULL" for k in keys))
    right = right.select(*keys)
    hot = hot_keys(left, keys, share)
    if hot is None:
        return whole.join(right, keys, "left_semi"), apart.unionByName(whole.join(right, keys, "left_anti"))
    many, rest = whole.join(hot, keys, "left_semi"), whole.join(hot, keys, "left_anti")
    few = F.broadcast(hot.join(right, keys, "left_semi"))
    return (many.join(few, keys, "left_semi").unionByName(rest.join(right, keys, "left_semi")),
            apart.unionByName(many.join(few, keys, "left_anti")).unionByName(rest.join(right, keys, "left_anti")))


__all__ = ["HOT_ROWS", "HOT_SHARE", "hot_keys", "hot_of", "join_unique", "split_by_keys"]
