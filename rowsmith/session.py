"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import logging
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

# Settings every job here relies on: adaptive execution re-plans joins and
# shuffle sizes at runtime (skew splitting included), the session clock is UTC
# and the UI server stays off. Spark's cleaner drops reliable-checkpoint files
# once the checkpointed data is out of scope (numbering and tree rounds write
# some on every call).
DEFAULT_CONF = {
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "rowsmith", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scale_conf(input_bytes: int, total_cores: int, partition_bytes: int = 256 << 20,
               max_partitions: int = 200_000) -> dict[str, str]:
    """Settings for a cluster run over ``input_bytes`` of Parquet.

    The initial shuffle partition count is sized so a shuffle of the whole
    input gives partitions of about ``partition_bytes`` (they must fit an
    executor's memory share, or they spill), never fewer than two waves of
    the cluster's cores, and at most ``max_partitions`` (map-output metadata
    grows with the count; real shuffles carry far less than the whole input
    after pruning and partial aggregation). Adaptive execution then merges small post-shuffle
    partitions to the advisory size, and splits a partition five times the
    median and over the threshold when a hot key lands in it. File splits are
    kept at the same size, so a scan task reads about one partition's worth.

    Broadcasts stay bounded: the static choice compares an estimate from file
    sizes with the threshold, and compressed Parquet grows in memory, so the
    estimate is scaled up (a compression factor of 4); the runtime choice of
    adaptive execution uses measured shuffle sizes. Both thresholds are
    stated explicitly (32 MB).
    """
    wanted = max(2 * total_cores, -(-input_bytes // partition_bytes))
    parts = min(max_partitions, wanted)
    if parts < wanted:
        log.warning("%d shuffle partitions instead of %d: a shuffle of the whole input has %d MB in each",
                    parts, wanted, input_bytes // parts >> 20)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.sources.fileCompressionFactor": "4.0",
        "spark.sql.autoBroadcastJoinThreshold": str(32 << 20),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 << 20),
    }


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for reliable checkpoints and job outputs.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that one is
    used. Only when it is unset and the master is local (unit tests, a laptop)
    is a scratch folder of our own made; on a cluster, where executors could
    not see it, that is an error.
    On a Spark Connect session (no SparkContext on the client) the server's
    ``spark.checkpoint.dir`` is what ``checkpoint()`` uses; it is returned.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: no JVM context on the client
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a Connect session")
        return named
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="rowsmith-ckpt-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def path_kind(spark: SparkSession, path: str) -> str | None:
    """``'folder'``, ``'file'`` or None (nothing there), in whatever store the path names."""
    fs, target = _file_system(spark, path)
    if not fs.exists(target):
        return None
    return "folder" if fs.getFileStatus(target).isDirectory() else "file"


def list_names(spark: SparkSession, path: str) -> list[str]:
    """The names of what a folder holds (none if it does not exist)."""
    fs, target = _file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file, or a folder with all in it."""
    fs, target = _file_system(spark, path)
    fs.delete(target, True)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        delete_path(spark, path)
    except Exception:  # noqa: BLE001 - the application is ending, its JVM may be gone already
        pass


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A fresh sub-folder of the checkpoint root, one per call. It belongs to
    this application and is deleted when the application ends."""
    root = checkpoint_root(spark).rstrip("/")
    path = f"{root}/{kind}/{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    for scope in _SCOPES:
        scope.append(path)
    return path


def scratch_table(spark: SparkSession, kind: str) -> str:
    """A fresh table name, one per call; a table of that name is dropped when the application ends."""
    name = f"rowsmith_{kind}_{uuid.uuid4().hex}"
    atexit.register(_drop, spark, name)
    return name


def _drop(spark: SparkSession, table: str) -> None:
    with contextlib.suppress(Exception):  # the application is ending, its JVM may be gone already
        spark.sql(f"DROP TABLE IF EXISTS {table}")


# Open ``temporary`` blocks, each with the folders made in it.
_SCOPES: list[list[str]] = []


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Folders of ``scratch_path`` and ``stored`` that are made in this block are deleted at its end.

    For a job that ends with a write of its own: what it read on the way is not needed after that write. Blocks belong to one thread."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for path in made:
            _delete(spark, path)


def free(*frames: DataFrame) -> None:
    """Delete the folders of these ``stored`` frames, which nothing will read again."""
    for df in frames:
        delete_path(df.sparkSession, df.stored_in)


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor re-reads files instead of redoing
    the job, and several readers do not redo it either. A stored table also
    has a shuffle of its own in a later join, which adaptive execution can
    split for a hot key; an aggregate right under the join has not."""
    path = scratch_path(df.sparkSession, kind)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_in = path  # for ``free``
    return out


def small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it is counted to have at most
    ``max_rows`` rows; unmarked otherwise. For stored tables of short rows."""
    return F.broadcast(df) if df.count() <= max_rows else df


def key_counts(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(rows, rows of the most frequent key) in one job, map-side combined; a key with a NULL part counts as no key."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(whole).alias("__whole"))
    rows, most = counts.agg(F.sum("__n"), F.max(F.when(F.col("__whole"), F.col("__n")))).first()
    return rows or 0, most or 0


def require_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """``df``, checked to hold no key twice (one map-side combined count; keys
    with a NULL part match nothing and are not checked)."""
    return require_all_unique([(df, keys, what)])[0]


def require_all_unique(tables: list[tuple[DataFrame, list[str], str]]) -> list[DataFrame]:
    """The frames of (frame, keys, what), each checked by ``require_unique``'s rule, all in one job."""
    if not tables:
        return []
    parts = [df.dropna(subset=keys).select(F.lit(i).alias("__t"), F.array(*[F.col(k).cast("string") for k in keys]).alias("__k"))
             if len(tables) > 1 else df.dropna(subset=keys).select(F.lit(0).alias("__t"), F.struct(*keys).alias("__k"))
             for i, (df, keys, _) in enumerate(tables)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    again = rows.groupBy("__t", "__k").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__t").limit(1).collect()
    if again:
        _, keys, what = tables[again[0][0]]
        raise ValueError(f"{what} holds a key more than once: {', '.join(keys)}")
    return [df for df, _, _ in tables]


def stored_lookup(df: DataFrame, keys: list[str], kind: str, max_rows: int = 100_000) -> DataFrame:
    """``df`` as a stored look-up: ``small(stored(df))`` whose ``keys`` were checked to be unique.

    Rows and the most frequent key are observed by the job that writes the table, so neither costs a job of its own.
    A key held twice raises; a key with a NULL part is no key.
    """
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    seen = Observation()
    counted = df.withColumn("__n", F.count(F.when(whole, 1)).over(Window.partitionBy(*keys)))
    out = stored(counted.observe(seen, F.count(F.lit(1)).alias("rows"), F.max("__n").alias("most")).drop("__n"), kind)
    if (seen.get["most"] or 0) > 1:
        raise ValueError(f"the look-up holds a key more than once: {', '.join(keys)}")
    return F.broadcast(out) if seen.get["rows"] <= max_rows else out


__all__ = ["build_session", "checkpoint_root", "delete_path", "free", "key_counts", "list_names", "path_kind", "require_all_unique",
           "require_unique", "scratch_path", "scratch_table", "scale_conf", "small", "stored", "stored_lookup", "temporary", "DEFAULT_CONF"]
