"""S2 as a load that keeps going: rows that do not fit are set apart, not fatal.

``load_apart`` shapes rows as ``tables.load_with_defaults`` does, but a value
that cannot be read is a *problem* of its row instead of an error. One pass
tags every row, writes the rows without a problem and the refused ones into two
folders of one output, and counts both with an ``Observation`` of the same
job: the input is read once, nothing is shuffled, and no row is lost.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from rowsmith.sources.tables import _is_mdy_text, _read_date, refuse_unknown_columns

LOADED, REFUSED = "loaded", "refused"
PROBLEMS = "array<struct<column_name: string, value: string>>"


@dataclass(frozen=True)
class Load:
    loaded: DataFrame  # rows of the schema, computed columns added
    refused: DataFrame  # the input's columns as text, and ``problems`` (column_name, value)
    n_loaded: int
    n_refused: int


def _shape(df: DataFrame, schema: T.StructType, defaults: Mapping[str, object], mdy_pivot: int | None) -> list[Column]:
    """The schema's columns, NULL where a value of ``df`` cannot be read."""
    out = []
    for f in schema.fields:
        if f.name not in df.columns:
            out.append(F.lit(defaults.get(f.name)).cast(f.dataType))
        elif mdy_pivot is not None and _is_mdy_text(df, f):
            out.append(_read_date(f.name, mdy_pivot).cast(f.dataType))
        elif df.schema[f.name].dataType == f.dataType:
            out.append(F.col(f.name))
        else:
            out.append(F.col(f.name).try_cast(f.dataType))
    return [c.alias(f.name) for c, f in zip(out, schema.fields)]


def load_apart(df: DataFrame, schema: T.StructType, path: str, defaults: Mapping[str, object] | None = None,
               computed: Mapping[str, Column] | None = None, mdy_pivot: int | None = None) -> Load:
    """Load ``df`` into ``path``: rows that fit ``schema`` under ``part=loaded``, all others under ``part=refused``.

    Absent columns take their DEFAULT, a NULL stays NULL and is no problem, a column that the schema does not have raises (it
    is a fault of the file, not of a row). A refused row keeps all its values as text, with each value that could not be read,
    so it can be mended and loaded again. A load that is run again overwrites ``path``.
    """
    refuse_unknown_columns(df, schema)
    read = [f.name for f in schema.fields if f.name in df.columns and df.schema[f.name].dataType != f.dataType]
    source = F.struct(*[F.col(c).cast("string").alias(c) for c in df.columns])
    shaped = df.select(source.alias("source"), F.struct(*_shape(df, schema, dict(defaults or {}), mdy_pivot)).alias("row"))
    problem = lambda c: F.when(
        F.col(f"source.`{c}`").isNotNull() & F.col(f"row.`{c}`").isNull(),
        F.struct(F.lit(c).alias("column_name"), F.col(f"source.`{c}`").alias("value")))
    problems = F.array_compact(F.array(*map(problem, read))) if read else F.array().cast(PROBLEMS)
    fits = F.size("problems") == 0
    counts = Observation()
    tagged = (shaped.withColumn("problems", problems)
              .select(F.when(fits, F.lit(LOADED)).otherwise(F.lit(REFUSED)).alias("part"), F.when(fits, F.col("row")).alias("row"),
                      F.when(~fits, F.col("source")).alias("source"), F.when(~fits, F.col("problems")).alias("problems"))
              .observe(counts, F.count(F.when(F.col("part") == LOADED, 1)).alias(LOADED),
                       F.count(F.when(F.col("part") == REFUSED, 1)).alias(REFUSED)))
    tagged.write.mode("overwrite").partitionBy("part").parquet(path)
    both = df.sparkSession.read.schema(tagged.schema).parquet(path)
    loaded = both.where(F.col("part") == LOADED).select("row.*")
    for name, expr in (computed or {}).items():
        loaded = loaded.withColumn(name, expr)
    return Load(loaded, both.where(F.col("part") == REFUSED).select("source.*", "problems"),
                counts.get[LOADED], counts.get[REFUSED])
