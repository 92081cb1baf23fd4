"""Number the rows of a sorted result 0..n-1 without a one-partition window.

Plan: a global sort (range-partitioned, so every partition holds a contiguous
key range), a per-partition running index from
``monotonically_increasing_id``, a reliable checkpoint so the numbering is
fixed even if an executor is lost and a partition re-runs, then the offset of
each partition from one small count per partition. The counts are as many
values as there are partitions (not rows), which is the only thing brought to
the driver; the offsets go back as a frame of one row per partition, joined
with an explicit broadcast (its size is bounded by the partition count, known
before the join), so the numbered rows are never shuffled and no
single-task window is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.session import checkpoint_root

_PID, _MID = "__pos_pid", "__pos_mid"


def with_position(df: DataFrame, order_by: Sequence[Column | str], pos_col: str = "position",
                  start: int | Column = 0) -> DataFrame:
    """Rows of ``df`` sorted by ``order_by`` with ``pos_col`` = start, start+1, ...

    The order must be total (add a unique key last) for the numbering to be
    deterministic. ``start`` may be a Column (e.g. a high-water mark).
    """
    checkpoint_root(df.sparkSession)
    tagged = (df.orderBy(*order_by)
                .select("*", F.spark_partition_id().alias(_PID),
                        F.monotonically_increasing_id().alias(_MID))
                .checkpoint(eager=True))
    counts = dict(tagged.groupBy(_PID).count().collect())
    offsets, acc = [], 0
    for pid in sorted(counts):
        offsets.append((pid, acc))
        acc += counts[pid]
    spark = df.sparkSession
    offset_df = spark.createDataFrame(offsets, f"{_PID} int, __pos_offset long")
    within = F.col(_MID) - F.shiftleft(F.col(_PID).cast("long"), 33)
    start_c = start if isinstance(start, Column) else F.lit(start)
    return (tagged.join(F.broadcast(offset_df), _PID)
                  .withColumn(pos_col, (start_c + F.col("__pos_offset") + within).cast("long"))
                  .drop(_PID, _MID, "__pos_offset"))
