"""Table scans with declared schemas (S1), typed loads with defaults (S2),
named views (S3) and a table sink.

Scans never infer: each table has a fixed ``StructType`` and the files
(Parquet by default; ORC, CSV and JSON too) are read with it, so column
pruning and filter pushdown reach the file scan.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsmith.functions.dates import parse_mdy

L, I, D, S, TS = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampNTZType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS: dict[str, T.StructType] = {
    "region": _schema(("r_regionkey", I), ("r_name", S)),
    "nation": _schema(("n_nationkey", I), ("n_name", S), ("n_regionkey", I)),
    "customer": _schema(("c_custkey", L), ("c_name", S), ("c_nationkey", I), ("c_acctbal", D),
                        ("c_mktsegment", S)),
    "supplier": _schema(("s_suppkey", L), ("s_name", S), ("s_nationkey", I), ("s_acctbal", D)),
    "part": _schema(("p_partkey", L), ("p_name", S), ("p_brand", S), ("p_type", S), ("p_size", I),
                    ("p_retailprice", D)),
    "orders": _schema(("o_orderkey", L), ("o_custkey", L), ("o_orderstatus", S), ("o_totalprice", D),
                      ("o_orderdate", TS), ("o_orderpriority", S)),
    "lineitem": _schema(("l_orderkey", L), ("l_partkey", L), ("l_suppkey", L), ("l_linenumber", I),
                        ("l_quantity", D), ("l_extendedprice", D), ("l_discount", D), ("l_tax", D),
                        ("l_returnflag", S), ("l_linestatus", S), ("l_shipdate", TS)),
    "events": _schema(("event_id", L), ("ts", TS), ("user_id", L), ("event_type", S), ("value", D),
                      ("props", S)),
    "documents": _schema(("doc_id", L), ("text", S), ("lang", S), ("source", S), ("n_chars", L)),
    "labels": _schema(("doc_id", L), ("quality", I), ("toxic", I)),
    "embeddings": _schema(("vec_id", L), ("embedding", T.ArrayType(T.FloatType(), True)), ("label", I)),
    "pages": _schema(("page_id", L), ("url", S), ("html", S)),
    "benchmark": _schema(("item_id", L), ("text", S)),
    "conversations": _schema(("conv_id", L), ("turn", L), ("role", S), ("text", S)),
}

TABLES = tuple(SCHEMAS)


FORMATS = ("parquet", "orc", "csv", "json")


def table_path(base: str, name: str, fmt: str = "parquet") -> str:
    """Where table ``name`` lives: ``base`` may be a template holding
    ``{table}`` (one folder per table anywhere), else ``<base>/<name>.<fmt>``."""
    if "{table}" in base:
        return base.format(table=name)
    return f"{base.rstrip('/')}/{name}.{fmt}"


def scan(spark: SparkSession, base: str, name: str, columns: list[str] | None = None,
         fmt: str = "parquet") -> DataFrame:
    """Read one table with its declared schema (never inferred); optional
    projection. Parquet and ORC push filters and prune columns at the scan;
    CSV (with a header line) and JSON lines are read with the same schema."""
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} not in {FORMATS}")
    reader = spark.read.schema(SCHEMAS[name])
    if fmt == "csv":
        reader = reader.option("header", "true")
    df = reader.format(fmt).load(table_path(base, name, fmt))
    return df.select(*columns) if columns else df


class Catalog:
    """Lazy accessor: ``Catalog(spark, base).orders`` is a scan of orders."""

    def __init__(self, spark: SparkSession, base: str, fmt: str = "parquet"):
        self.spark, self.base, self.fmt = spark, base, fmt

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        return scan(self.spark, self.base, name, fmt=self.fmt)

    def table(self, name: str) -> DataFrame:
        return scan(self.spark, self.base, name, fmt=self.fmt)


def _is_mdy_text(df: DataFrame, field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType, T.DateType)) \
        and isinstance(df.schema[field.name].dataType, T.StringType)


def _read_date(column: str, pivot: int) -> Column:
    """``MM/DD/YY`` text, or ISO text, as a zone-less timestamp; NULL for any other."""
    return F.coalesce(parse_mdy(column, pivot), F.col(column).try_cast("timestamp_ntz"))


def unreadable_dates(df: DataFrame, schema: T.StructType, keep: list[str], mdy_pivot: int = 50) -> DataFrame:
    """(keep..., column_name, value): the texts that a load with ``mdy_pivot`` would refuse."""
    named = [f.name for f in schema.fields if f.name in df.columns and _is_mdy_text(df, f)]
    bad = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & _read_date(c, mdy_pivot).isNull(),
                                           F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"))) for c in named]))
    return df.select(*keep, F.explode_outer(bad).alias("__bad")).where("__bad is not null").select(*keep, "__bad.*")


def refuse_unknown_columns(df: DataFrame, schema: T.StructType) -> None:
    unknown = set(df.columns) - {f.name for f in schema.fields}
    if unknown:
        raise ValueError(f"columns that the schema does not have: {', '.join(sorted(unknown))}")


def load_with_defaults(df: DataFrame, schema: T.StructType,
                       defaults: Mapping[str, object] | None = None,
                       computed: Mapping[str, Column] | None = None, mdy_pivot: int | None = None) -> DataFrame:
    """Shape ``df`` to ``schema``.

    Present columns are cast to the declared type (ANSI casts: a value that
    does not fit raises). A column *absent* from ``df`` takes its DEFAULT, or
    NULL when it has none. A column present but NULL keeps NULL; the default
    does not fill it (a NOT NULL rule then reports it, see ``rules``).
    ``computed`` adds derived columns after the load (computed-by columns).
    A column of ``df`` that the schema does not know raises.

    With ``mdy_pivot``, text for a timestamp column is read as ``MM/DD/YY``
    (two-digit years from the pivot on are 19yy) or as ISO text; text that is
    no such date raises, with ANSI on or off. ``unreadable_dates`` lists such
    rows; ``quarantine.load_apart`` loads the good ones and keeps the others.
    """
    defaults = dict(defaults or {})
    have = set(df.columns)
    refuse_unknown_columns(df, schema)
    cols = []
    for f in schema.fields:
        if f.name in have and mdy_pivot is not None and _is_mdy_text(df, f):
            # each form is read once a row, and only where the one before it gave nothing
            bad = F.raise_error(F.concat(F.lit(f"{f.name} is no MM/DD/YY date: "), F.col(f.name)))
            cols.append(F.coalesce(_read_date(f.name, mdy_pivot), F.when(F.col(f.name).isNotNull(), bad.cast("timestamp_ntz")))
                         .cast(f.dataType).alias(f.name))
        elif f.name in have:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            value = defaults.get(f.name)
            c = F.lit(value) if value is not None else F.lit(None)
            cols.append(c.cast(f.dataType).alias(f.name))
    out = df.select(*cols)
    for name, expr in (computed or {}).items():
        out = out.withColumn(name, expr)
    return out


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                sort_within: list[str] | None = None, mode: str = "overwrite") -> None:
    """Sink: write a table. ``sort_within`` orders rows inside each output
    file by the usual filter column, so Parquet min/max statistics let later
    scans skip row groups (the layout stand-in for an index)."""
    if sort_within:
        df = df.sortWithinPartitions(*sort_within)
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.save(path)


def write_bucketed(df: DataFrame, path: str, table_name: str, buckets: int, key: str,
                   sort_by: list[str] | None = None) -> DataFrame:
    """Sink: write ``df`` as a table bucketed (hash-partitioned) on ``key``
    at ``path`` and register it as ``table_name``; returns the table. A scan
    of it reports that partitioning, so later joins, aggregates and windows
    keyed by ``key`` need no shuffle; two tables with the same number of
    buckets on their join keys are joined bucket by bucket. The one shuffle is
    paid here, and leaves one file a bucket instead of one a task and bucket."""
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(*(sort_by or [key])).option("path", path)
       .mode("overwrite").saveAsTable(table_name))
    return df.sparkSession.table(table_name)


def register_view(df: DataFrame, name: str) -> DataFrame:
    """S3: publish a DataFrame as a named temporary view and hand it back."""
    df.createOrReplaceTempView(name)
    return df
