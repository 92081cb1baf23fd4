"""Fixed-width text report (``%-20s %-15s %s`` style) and its text sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.operators.positions import with_position
from rowsmith.session import checkpoint_root


def pad_right(c: Column, width: int) -> Column:
    """``%-Ns``: pad with blanks to ``width``; longer values are kept whole
    (``rpad`` alone would cut them)."""
    return F.when(F.length(c) >= width, c).otherwise(F.rpad(c, width, " "))


def fixed_width_line(cols: Sequence[Column], widths: Sequence[int | None], sep: str = " ") -> Column:
    """One report line: each column padded to its width, the last one (width
    ``None``) as is. A NULL field prints as the empty string, like ``%s`` of
    an empty buffer."""
    parts = []
    for c, w in zip(cols, widths):
        c = F.coalesce(c.cast("string"), F.lit(""))
        parts.append(pad_right(c, w) if w else c)
    return F.concat_ws(sep, *parts)


def fixed_width_report(df: DataFrame, columns: Sequence[str], widths: Sequence[int | None],
                       heading: Sequence[str] | None = None, line_col: str = "line",
                       order_by: Sequence[Column | str] | None = None) -> DataFrame:
    """Lines of the report: (line_no, line). The heading is line 0. With
    ``order_by`` (a total order) the data lines are numbered 1..n in that
    order by the distributed numbering of ``positions.with_position``;
    without it every data line has line_no 1 and no order."""
    line = fixed_width_line([F.col(c) for c in columns], widths).alias(line_col)
    if order_by:
        body = with_position(df, order_by, "__line_no", start=1).select(F.col("__line_no").alias("line_no"), line)
    else:
        body = df.select(F.lit(1).cast("long").alias("line_no"), line)
    if heading is None:
        return body
    head_row = df.sparkSession.range(0, 1, 1, 1).select(
        F.lit(0).cast("long").alias("line_no"),
        fixed_width_line([F.lit(h) for h in heading], widths).alias(line_col))
    return head_row.unionByName(body)


def write_text_report(lines: DataFrame, path: str, line_col: str = "line", order_col: str = "line_no",
                      in_order: bool = False) -> None:
    """Sink: one text line per row (``DataFrame.write.text``), overwriting.
    The part files, read in the order of their numbers, give the report in
    order; no task merges them.

    A report numbered by ``fixed_width_report(order_by=...)`` is in order
    already: its partitions hold consecutive lines, the heading first. With
    ``in_order`` they are written as they are, by partition number, and the
    one range shuffle of the numbering is the only one. Other frames are
    range-sorted on ``order_col`` here."""
    if not in_order and order_col in lines.columns:
        lines = lines.orderBy(order_col)
    lines.select(line_col).write.mode("overwrite").text(path)


def read_text_report(spark: SparkSession, path: str, line_col: str = "line") -> DataFrame:
    """The lines of a written report with their place in it: (line_no from 0, line).

    Files are split where Spark splits them. The first line of each split comes from one count for each, broadcast
    as a frame of one row a split; lines are not shuffled.
    """
    checkpoint_root(spark)
    # the reliable checkpoint fixes which task numbered which line
    tagged = (spark.read.text(path).select(
        F.col("value").alias(line_col), F.col("_metadata.file_name").alias("__file"), F.col("_metadata.file_block_start").alias("__at"),
        F.monotonically_increasing_id().alias("__id")).checkpoint(eager=True))
    splits = tagged.groupBy("__file", "__at").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("first")).collect()
    offsets, before = [], 0
    for r in sorted(splits, key=lambda r: (int(r["__file"].split("-")[1]), r["__file"], r["__at"])):
        offsets.append((r["__file"], r["__at"], before - r["first"]))
        before += r["n"]
    known = spark.createDataFrame(offsets, "__file string, __at long, __shift long")
    return tagged.join(F.broadcast(known), ["__file", "__at"]).select((F.col("__id") + F.col("__shift")).alias("line_no"), line_col)
