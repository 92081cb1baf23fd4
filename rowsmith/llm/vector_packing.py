"""Sharding by vector bin packing.

Rows fall into groups of equal texts. A group that holds more than a small
share of all bytes, tokens or rows is numbered in pieces; all other groups are
joined by hash into cells. Cells and pieces are a bounded number of (bytes,
tokens, rows) vectors. The pieces of a group go to one shard, unless the group
is over ``WHOLE`` of a shard's capacity: then its pieces are placed one by one.
What is placed goes largest first, each into the shard where the dot product
of its vector with the shard's residual capacity is highest; moves of small
items then even out the bytes that greedy placing left over, as far as tokens
and rows allow. Rows never pass through the driver, only the vectors.

Inside a shard the rows get gapless slots: each item has a start slot, and
its rows are numbered from there, so no task ever sees a whole shard.

A null text has no bytes, so its size is 1; null texts are one group, empty
texts another. Very long texts are measured whole; one that outweighs a shard stays whole too. Repeated rows (equal in all columns, the id included) are placed
one by one; a tie of ids inside an item is broken by the row's position in the
stored table, which is fixed before anything is numbered. An empty table gives
an empty result. Kept columns named like a result column give way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rowsmith.llm.common import WORD_PATTERN, stored, table

DIMENSIONS = ("bytes", "tokens", "rows")
#: Share of a shard's capacity up to which a group of equal texts stays in one shard.
WHOLE = 0.5


def place(items: np.ndarray, n_shards: int, tolerance: float = 0.001, moves: int = 20_000,
          slack: float = 0.005) -> np.ndarray:
    """Shard of each item. ``items``: one row (bytes, tokens, rows) each.

    Every dimension is scaled so that a shard's capacity is 1 in each; bytes
    are then evened out by moving items from the fullest to the emptiest shard
    until the two differ by at most ``tolerance`` of a shard. A move is taken only
    if it leaves both shards, in each other dimension, within ``slack`` of the
    capacity or no farther from it than the worse of them was.
    """
    capacity = np.maximum(items.sum(axis=0) / n_shards, 1e-9)
    scaled = items / capacity
    order = np.lexsort((np.arange(len(items)), -scaled.max(axis=1)))
    residual = np.ones((n_shards, items.shape[1]))
    shard = np.zeros(len(items), dtype=np.int64)
    for i in order:
        s = int(np.argmax(residual @ scaled[i]))
        shard[i] = s
        residual[s] -= scaled[i]
    size = items[:, 0]
    load = np.bincount(shard, weights=size, minlength=n_shards)
    others = np.stack([np.bincount(shard, weights=w, minlength=n_shards) for w in scaled[:, 1:].T], axis=1) - 1

    def fits(change):
        """Which changes (scaled, one row each) of the other dimensions from hi to lo are within the bound."""
        worst = np.maximum(slack, np.maximum(np.abs(others[hi]), np.abs(others[lo]))) + 1e-12
        return ((np.abs(others[hi] - change) <= worst) & (np.abs(others[lo] + change) <= worst)).all(axis=1)

    for _ in range(moves):
        hi, lo = int(np.argmax(load)), int(np.argmin(load))
        gap = load[hi] - load[lo]
        if gap <= tolerance * capacity[0]:
            break
        here = np.flatnonzero(shard == hi)
        fit = here[(size[here] > 0) & (size[here] < gap)]
        fit = fit[fits(scaled[fit, 1:])]
        best, gain = None, 0.0
        if len(fit):  # one item moved: best if it is half the gap
            k = fit[np.argmin(np.abs(size[fit] - gap / 2))]
            best, gain = (k, None), gap - abs(gap - 2 * size[k])
        there = np.flatnonzero(shard == lo)
        if len(there) and len(here):  # two items exchanged
            back = there[np.argsort(size[there], kind="stable")]
            at = np.clip(np.searchsorted(size[back], size[here] - gap / 2), 0, len(back) - 1)
            left = np.where(fits(scaled[here, 1:] - scaled[back[at], 1:]), np.abs(gap - 2 * (size[here] - size[back[at]])), np.inf)
            k = int(np.argmin(left))
            if gap - left[k] > gain:
                best, gain = (here[k], back[at[k]]), gap - left[k]
        if best is None or gain <= 0:
            break
        for k, to, sign in ((best[0], lo, 1), (best[1], hi, -1)):
            if k is not None:
                shard[k] = to
                load[lo] += sign * size[k]
                load[hi] -= sign * size[k]
                others[lo] += sign * scaled[k, 1:]
                others[hi] -= sign * scaled[k, 1:]
    return shard


def pack(docs: DataFrame, n_shards: int, keep: list[str], text_col: str = "text", id_col: str = "doc_id",
         cells_per_shard: int = 256, rows_per_cell: int = 200_000) -> DataFrame:
    """The columns ``keep`` of every row with ``size``, ``text_crc32``, ``shard`` and ``slot``.

    A group of over 1 / (64 ``n_shards``) of all bytes, tokens or rows is
    numbered in pieces, so there are under 3 * 64 * ``n_shards`` such groups. The number of
    cells grows with the rows, to keep a cell's rows at most about
    ``rows_per_cell``.
    """
    raw = F.encode(F.col(text_col), "UTF-8")
    keyed = stored(docs.select(
        F.struct(*keep).alias("row"), F.col(id_col).alias("id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("tokens"),
        F.coalesce(F.crc32(raw), F.lit(0)).alias("crc"), F.xxhash64(text_col, F.col(text_col).isNull()).alias("hash"),
        F.monotonically_increasing_id().alias("position")).withColumn("bytes", F.col("bytes") + 1), "packing_rows")
    sums = [F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = keyed.agg(*sums).first()
    n_rows = total["rows"]
    pieces_of_all = 64 * n_shards
    cells = max(cells_per_shard * n_shards, -(-n_rows // rows_per_cell))
    kept = [f"row.`{c}`" for c in keep if c not in ("size", "text_crc32", "shard", "slot")]

    # groups over the share, with the number of pieces each is cut into: under 3 * pieces_of_all rows
    share = F.greatest(*[F.col(d) * pieces_of_all / float(max(1, total[d] or 0)) for d in DIMENSIONS])
    hot = sorted(tuple(r) for r in keyed.groupBy("hash", "crc").agg(*sums).withColumn("share", share)
                 .where((F.col("share") > 1) & (F.col("rows") > 1))
                 .select("hash", "crc", F.least(F.ceil("share"), F.col("rows")).cast("int").alias("pieces"),
                         (F.col("share") <= WHOLE * pieces_of_all / n_shards).alias("whole")).collect())
    spark = docs.sparkSession
    starts = np.cumsum([cells, *[h[2] for h in hot]]).tolist()
    # from Arrow tables: a list of rows would start Python workers on the executors
    cut = spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(
        ([h[0] for h in hot], [h[1] for h in hot], [h[2] for h in hot], starts[:-1]), (pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
        names=["hash", "crc", "pieces", "first_item"]))
    item = F.when(F.col("pieces").isNull(), F.pmod("hash", F.lit(cells))).otherwise(
        F.col("first_item") + F.pmod(F.xxhash64("position"), F.col("pieces")))
    placed = keyed.join(F.broadcast(cut), ["hash", "crc"], "left").withColumn("item", item)

    found = placed.groupBy("item").agg(*sums).orderBy("item").toPandas()
    vectors = found[list(DIMENSIONS)].to_numpy(dtype=float)
    # the pieces of a group that stays whole are placed as one
    unit = found["item"].to_numpy().copy()
    if hot:
        group = np.searchsorted(starts[:-1], unit, side="right") - 1
        whole = (group >= 0) & np.array([h[3] for h in hot])[group]
        unit[whole] = np.array(starts)[group[whole]]
    unit = np.unique(unit, return_inverse=True)[1]
    units = np.stack([np.bincount(unit, weights=w) for w in vectors.T], axis=1)
    shard = place(units, n_shards)[unit] if len(found) else np.zeros(0, dtype=np.int64)
    start = np.zeros(len(found), dtype=np.int64)
    for s in range(n_shards):
        mine = np.flatnonzero(shard == s)
        start[mine] = np.cumsum(found["rows"].to_numpy()[mine]) - found["rows"].to_numpy()[mine]
    where = spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(
        (found["item"].to_numpy(), shard, start), (pa.int64(), pa.int32(), pa.int64()))], names=["item", "shard", "start"]))
    order = Window.partitionBy("item").orderBy("id", "position")
    return (placed.join(F.broadcast(where), "item")
            .withColumn("slot", F.col("start") + F.row_number().over(order) - 1)
            .select(*kept, F.col("bytes").alias("size"), F.col("crc").alias("text_crc32"), "shard", "slot"))


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal size in bytes (law ``bytes``)."""
    packed = pack(table(spark, sf_dir, "documents"), 16, ["doc_id"])
    return packed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
