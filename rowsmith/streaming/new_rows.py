"""New-row notification on a growing table, with Structured Streaming.

The AFTER INSERT trigger that posts an event per new row becomes a file-stream
query: each micro-batch holds the rows of the files that arrived since the
last batch; the batch is counted by type (a map-side combined aggregate, so a
batch costs one row per type, not per new row) and written under its own
``batch_id`` folder. A batch that is re-run after a failure overwrites its own
folder, so the notices are exactly-once; the stream's checkpoint records
which files were already seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsmith.session import path_kind, scratch_path


def start_new_row_notices(spark: SparkSession, source_dir: str, schema: T.StructType, type_col: str,
                          out_dir: str, checkpoint_dir: str, file_glob: str | None = None,
                          available_now: bool = True, max_files_per_trigger: int | None = None,
                          every: str = "5 seconds"):
    """Start the stream; returns the ``StreamingQuery``. ``out_dir`` receives
    (``type_col``, n_new) per batch under ``batch_id=<n>``. A stream that is
    not ``available_now`` keeps running, with a batch ``every`` so often."""
    if path_kind(spark, source_dir) is None:
        raise FileNotFoundError(source_dir)
    reader = spark.readStream.schema(schema)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.parquet(source_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        (batch.groupBy(type_col).agg(F.count(F.lit(1)).alias("n_new"))
              .write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}"))

    writer = rows.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


def read_notices(spark: SparkSession, out_dir: str, type_col: str) -> DataFrame:
    """All notices written so far, summed per type: (``type_col``, n_new)."""
    schema = T.StructType([T.StructField(type_col, T.StringType()), T.StructField("n_new", T.LongType()),
                           T.StructField("batch_id", T.LongType())])
    if path_kind(spark, out_dir) is None:  # no batch has run yet
        notices = spark.createDataFrame([], schema)
    else:
        notices = spark.read.schema(schema).parquet(out_dir)
    return (notices
                 .groupBy(type_col).agg(F.sum("n_new").cast("long").alias("n_new")))


def new_row_counts(spark: SparkSession, source_dir: str, schema: T.StructType, type_col: str,
                   file_glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Run the stream over everything available now (fresh checkpoint and
    output folders under the shared checkpoint root, which go when the
    application ends), wait for it, and return the notices read back as a
    batch DataFrame. ``source_dir`` may be a table's folder or its only file.
    ``max_files_per_trigger`` cuts a large backlog into bounded micro-batches
    within the one run."""
    if path_kind(spark, source_dir) == "file":
        source_dir, _, file_glob = source_dir.rpartition("/")
    root = scratch_path(spark, "new_rows")
    q = start_new_row_notices(spark, source_dir, schema, type_col, f"{root}/notices",
                              f"{root}/_checkpoint", file_glob=file_glob,
                              max_files_per_trigger=max_files_per_trigger)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(f"stream failed: {q.exception()}")
    return read_notices(spark, f"{root}/notices", type_col)
