"""D1 on a stream: audit rows as new versions of a table's rows arrive.

The AFTER UPDATE trigger that compares the old and the new value of a row
becomes a file stream with keyed state. The state is the last value of
each key and where in the order of changes it stood. A micro-batch looks up the
state's rows of its keys and puts its rows behind them (shuffles by key of the batch's rows, not of the
state's); a row that differs from the one before it leaves an audit row, as ``operators.audit.audit_changes``
would between two snapshots, and the last row of each key goes to the state.

The state is a Parquet table bucketed by key, so that a look-up reads it without a shuffle. Every batch adds a part to it with the last rows
of its own keys; of a key in several parts, the newest holds. Parts are merged, bucket by bucket, once those behind a part hold
``MERGE_AT`` times its rows: there are few parts for any number of batches, the state takes at most ``MERGE_AT`` + 1 times the rows of its
oldest part, and a row is written again as often as the state grows by that factor.

Batch ``n`` reads the parts that an earlier batch lists, and writes its own parts and audit rows under its own
number, and its list last. A batch that runs again after a failure starts from the same
list and overwrites what it had written, so a stopped stream goes on where it
was and no audit row comes twice. The last two lists and their parts are kept.

A batch costs one pass over the state without exchanging or writing it, all of it on the JVM side. Versions of one key in
one batch are compared in one task.
"""

from __future__ import annotations

import contextlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from rowsmith.functions.dates import ntz_literal
from rowsmith.functions.scalars import percent_change
from rowsmith.session import delete_path, list_names, path_kind, scratch_path, scratch_table

_OLD, _AT, _VALUE, _KEPT, _PART = "__old", "__at", "__value", "__kept", "__part"

#: Parts of the state are merged when those behind one hold this many times its rows.
MERGE_AT = 3
#: Buckets of the state for each core, unless the session's shuffles have fewer partitions.
BUCKETS_PER_CORE = 4


def follow(state: DataFrame | None, batch: DataFrame, keys: Sequence[str], partitions: int | None = None) -> DataFrame:
    """The rows of ``batch`` that changed a value, and the last row of every key of both.

    Both frames have ``keys``, ``__at`` and ``__value``. Out: these, ``__old`` (the value before) and the flags
    ``changed`` and ``last``. A row older than the state's row of its key is late and says nothing; of equal ones the batch's row
    comes later. A NULL before or after is not a change. ``partitions``: how many to deal the rows to by key.
    """
    columns = [*keys, _AT, _VALUE]
    rows = batch.select(*columns, F.lit(False).alias(_KEPT))
    if state is not None:
        rows = rows.unionByName(state.select(*columns, F.lit(True).alias(_KEPT)))
    if partitions:
        rows = rows.repartition(partitions, *keys)
    key = Window.partitionBy(*keys)
    order = key.orderBy(_AT, F.desc(_KEPT), _VALUE)
    seen = F.max(F.when(F.col(_KEPT), F.col(_AT))).over(key)
    rows = rows.withColumn("__seen", seen).where(F.col(_KEPT) | F.col("__seen").isNull() | (F.col(_AT) >= F.col("__seen")))
    rows = rows.withColumn(_OLD, F.lag(_VALUE).over(order)).withColumn("last", F.lead(_AT).over(order).isNull())
    changed = ~F.col(_KEPT) & F.coalesce(F.col(_OLD) != F.col(_VALUE), F.lit(False))
    return rows.withColumn("changed", changed).where("changed or last").select(*columns, _OLD, "changed", "last")


@contextlib.contextmanager
def _part_table(spark: SparkSession, path: str, fields: Sequence[T.StructField], keys: Sequence[str], buckets: int, parts: Sequence[int]):
    """The name of a table over ``parts`` of the state under ``path``, bucketed by key. The files outlive the table."""
    name, quoted = scratch_table(spark, "audit_state"), [f"`{k}`" for k in keys]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    location = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}, {_PART} BIGINT) USING parquet PARTITIONED BY ({_PART}) "
              f"CLUSTERED BY ({', '.join(quoted)}) INTO {buckets} BUCKETS LOCATION '{location}'")
    try:
        if parts:
            spark.sql(f"ALTER TABLE {name} ADD " + " ".join(f"PARTITION ({_PART} = {p})" for p in parts))
        yield name
    finally:
        spark.sql(f"DROP TABLE {name}")


def _merge_from(rows: Sequence[int]) -> int:
    """The first of the parts (their rows, oldest first) to be merged with all behind it; ``len(rows)`` if none is."""
    for i in range(len(rows) - 1):
        if sum(rows[i + 1:]) >= MERGE_AT * rows[i]:
            return i
    return len(rows)


def _newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The state's row of each key: that of its newest part."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(_AT, _VALUE), _PART).alias("__row")).select(*keys, "__row.*")


def start_audit(spark: SparkSession, source_dir: str, schema: T.StructType, keys: Sequence[str], value: str, order: str,
                out_dir: str, checkpoint_dir: str, as_of, user: str, max_files_per_trigger: int | None = None,
                available_now: bool = True, every: str = "1 minute"):
    """Audit the Parquet files of ``source_dir`` as they come; returns the ``StreamingQuery``.

    Versions of a key are compared in the order of the integer column ``order``. A row without an ``order`` or with a NULL in
    its key is left out. ``out_dir`` receives ``audit_changes``'s columns under ``rows/batch_id=<n>``, the state's parts under ``parts`` and
    lists of them under ``state``; it belongs to the stream as its checkpoint does. A stream that is not ``available_now`` keeps running, with a batch ``every``
    so often.
    """
    keys = list(keys)
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    versions = (reader.parquet(source_dir).dropna(subset=[*keys, order])
                .select(*keys, F.col(order).cast("long").alias(_AT), F.col(value).alias(_VALUE)))
    states, parts_dir = f"{out_dir}/state", f"{out_dir}/parts"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        done = sorted(int(n) for n in list_names(session, states) if n.isdigit() and int(n) < batch_id
                      and path_kind(session, f"{states}/{n}/_SUCCESS"))
        listed = session.read.parquet(f"{states}/{done[-1]}").orderBy(_PART).collect() if done else []
        parts = [(r[_PART], r["rows"]) for r in listed if r["rows"]]  # one without rows has no folder
        buckets = listed[0]["buckets"] if listed else min(int(session.conf.get("spark.sql.shuffle.partitions")),
                                                          BUCKETS_PER_CORE * session.sparkContext.defaultParallelism)
        merged, own = 2 * batch_id, 2 * batch_id + 1  # newer than all listed ones
        for p in (merged, own):
            delete_path(session, f"{parts_dir}/{_PART}={p}")
        value_type = batch.schema[_VALUE].dataType
        fields = [*(batch.schema[c] for c in (*keys, _AT)), T.StructField(_VALUE, value_type), T.StructField(_OLD, value_type),
                  T.StructField("changed", T.BooleanType()), T.StructField("last", T.BooleanType())]
        with _part_table(session, parts_dir, fields, keys, buckets, [p for p, _ in parts]) as name:
            def add(rows: DataFrame, part: int) -> int:
                rows.select(*(f.name for f in fields), F.lit(part).cast("long").alias(_PART)).write.insertInto(name)
                return session.table(name).where((F.col(_PART) == part) & F.col("last")).count()

            at = _merge_from([n for _, n in parts])
            if at < len(parts):
                rows = _newest(session.table(name).where((F.col(_PART) >= parts[at][0]) & F.col("last")), keys)
                rows = rows.withColumns({_OLD: F.lit(None).cast(value_type), "changed": F.lit(False), "last": F.lit(True)})
                parts = [*parts[:at], (merged, add(rows, merged))]
            before = None
            if parts:
                state = session.table(name).where(F.col(_PART).isin([p for p, _ in parts]) & F.col("last"))
                asked = batch.select(*keys).repartition(buckets, *keys)  # dealt as the state is: that one stays where it lies
                before = _newest(state.join(asked, keys, "left_semi"), keys)
            parts.append((own, add(follow(before, batch, keys, buckets), own)))
            changes = session.table(name).where((F.col(_PART) == own) & F.col("changed"))
            (changes.select(*keys, ntz_literal(as_of).alias("change_date"), F.lit(user).alias("updater_id"),
                            F.col(_OLD).cast("double").alias("old_value"), F.col(_VALUE).cast("double").alias("new_value"),
                            percent_change(F.col(_OLD), F.col(_VALUE)).alias("percent_change"))
             .write.mode("overwrite").parquet(f"{out_dir}/rows/batch_id={batch_id}"))
        rows = ", ".join(f"({p}L, {n}L, {buckets})" for p, n in parts)
        session.sql(f"SELECT * FROM VALUES {rows} AS t({_PART}, rows, buckets)").write.mode("overwrite").parquet(f"{states}/{batch_id}")
        for n in done[:-1]:
            delete_path(session, f"{states}/{n}")
        kept = {f"{_PART}={p}" for p in [*(r[_PART] for r in listed), *(p for p, _ in parts)]}
        for folder in list_names(session, parts_dir):
            if folder.startswith(f"{_PART}=") and folder not in kept:
                delete_path(session, f"{parts_dir}/{folder}")

    writer = versions.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


def read_audit(spark: SparkSession, out_dir: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """All audit rows written so far, in ``audit_changes``'s columns."""
    fields = [schema[k] for k in keys] + [
        T.StructField("change_date", T.TimestampNTZType()), T.StructField("updater_id", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in ("old_value", "new_value", "percent_change")]]
    if path_kind(spark, f"{out_dir}/rows") is None:  # no batch has run yet
        return spark.createDataFrame([], T.StructType(fields))
    return spark.read.schema(T.StructType(fields)).parquet(f"{out_dir}/rows").select([f.name for f in fields])


def audit_files(spark: SparkSession, source_dir: str, schema: T.StructType, keys: Sequence[str], value: str, order: str,
                as_of, user: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Run the stream over all files of ``source_dir`` and return the audit rows that it wrote."""
    root = scratch_path(spark, "audit_stream")
    query = start_audit(spark, source_dir, schema, keys, value, order, root, f"{root}/_checkpoint", as_of, user, max_files_per_trigger)
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(f"stream failed: {query.exception()}")
    return read_audit(spark, root, schema, keys)
