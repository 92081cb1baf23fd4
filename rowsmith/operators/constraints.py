"""Many constraints over many tables in one scan a table (C1-C10 together).

A job per constraint reads a table once for each of its keys and references.
Here every row is expanded, in one pass, into the few facts that the
constraints need of it: a key it holds, a reference it makes, a key it offers
to references, a NULL or a broken rule. Facts of all tables are counted
by (constraint, key, value) with a map-side combined aggregate, the only
shuffle of rows:

* a key is duplicated if it was held more than once (C2, C3);
* a reference is an orphan if its key was never offered (C4-C6);
* a row conflicts with another table if its key was offered there (C10);
* a value is out of range by the range offered under its key (C9).

No join stands in the way, so a hot key is one partial count a task. Broken rules
and NULLs (C1, C7, C8) are facts without a key: only offending rows make any.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rowsmith.operators.rules import violated
from rowsmith.session import stored

#: Values and limits of range constraints are compared as this type.
VALUE = "decimal(38,10)"


@dataclass(frozen=True)
class Constraint:
    """One constraint of ``table``; ``kind`` and ``name`` label its row of the report."""
    table: str
    kind: str
    name: str


@dataclass(frozen=True)
class NotNull(Constraint):
    column: str


@dataclass(frozen=True)
class Check(Constraint):
    predicate: Column  # TRUE for a good row, unknown passes


@dataclass(frozen=True)
class Key(Constraint):
    columns: Sequence[str]
    null_is_distinct: bool = False  # UNIQUE: a key with a NULL part never collides


@dataclass(frozen=True)
class Reference(Constraint):
    columns: Sequence[str]
    other: str
    other_columns: Sequence[str]


@dataclass(frozen=True)
class InRange(Constraint):
    """``value`` between ``low`` and ``high`` of the row of ``other`` with the same key, if there is one."""
    columns: Sequence[str]
    value: str
    other: str
    other_columns: Sequence[str]
    low: str
    high: str


@dataclass(frozen=True)
class Conflict(Constraint):
    """No row with ``condition`` may have a row with ``other_condition`` under its key in ``other``."""
    columns: Sequence[str]
    condition: Column
    other: str
    other_columns: Sequence[str]
    other_condition: Column


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _fact(number: int, when: Column, key: Sequence[str] = (), offers: bool = False, **values: Column) -> Column:
    """A fact of constraint ``number`` about the rows where ``when`` holds; key parts are compared as text."""
    return F.when(when, F.struct(
        F.lit(number).alias("c"), F.array(*[F.col(k).cast("string") for k in key]).cast("array<string>").alias("key"),
        *[values.get(v, F.lit(None)).cast(VALUE).alias(v) for v in ("value", "low", "high")],
        F.lit(0 if offers else 1).cast("long").alias("held"), F.lit(1 if offers else 0).cast("long").alias("offered")))


def _facts(number: int, c: Constraint, table: str) -> list[Column]:
    """What the rows of ``table`` say about constraint ``c``."""
    out = []
    whole = lambda columns: _all(F.col(k).isNotNull() for k in columns)
    if table == c.table:
        if isinstance(c, NotNull):
            out.append(_fact(number, F.col(c.column).isNull()))
        elif isinstance(c, Check):
            out.append(_fact(number, violated(c.predicate)))
        elif isinstance(c, Key):
            out.append(_fact(number, whole(c.columns) if c.null_is_distinct else F.lit(True), c.columns))
        elif isinstance(c, Reference):
            out.append(_fact(number, whole(c.columns), c.columns))
        elif isinstance(c, InRange):
            out.append(_fact(number, whole([*c.columns, c.value]), c.columns, value=F.col(c.value)))
        elif isinstance(c, Conflict):
            out.append(_fact(number, whole(c.columns) & F.coalesce(c.condition, F.lit(False)), c.columns))
    if table == getattr(c, "other", None):
        offered = whole(c.other_columns)
        if isinstance(c, Conflict):
            offered = offered & F.coalesce(c.other_condition, F.lit(False))
        limits = {"low": F.col(c.low), "high": F.col(c.high)} if isinstance(c, InRange) else {}
        out.append(_fact(number, offered, c.other_columns, offers=True, **limits))
    return out


def facts(tables: Mapping[str, DataFrame], constraints: Sequence[Constraint]) -> DataFrame:
    """All facts, counted by (constraint, key, value): one scan a table and one shuffle of what it said."""
    said = None
    for name, df in tables.items():
        of = [f for i, c in enumerate(constraints) for f in _facts(i, c, name)]
        if of:
            # an outer generator gets no inferred filter, which would evaluate every rule twice
            rows = df.select(F.explode_outer(F.array(*of)).alias("f")).where("f is not null").select("f.*")
            said = rows if said is None else said.unionByName(rows)
    return (said.groupBy("c", "key", "value")
            .agg(F.sum("held").alias("held"), F.sum("offered").alias("offered"), F.min("low").alias("low"), F.max("high").alias("high")))


def report(tables: Mapping[str, DataFrame], constraints: Sequence[Constraint]) -> DataFrame:
    """One row a constraint: (table_name, kind, constraint_name, n_violations).

    ``n_violations`` counts duplicated key values for ``Key`` and offending rows for all other constraints. A constraint
    that names a table which is not given is reported with the kind ``not_checked`` and no count. A NULL is no broken rule, and a key
    with a NULL part makes no reference. The counts are written once; the report reads them.
    """
    checked = [c for c in constraints if {c.table, getattr(c, "other", c.table)} <= set(tables)]
    spark = next(iter(tables.values())).sparkSession
    if not checked:
        broken = spark.createDataFrame([], "c int, n long")
    else:
        counted = stored(facts(tables, checked), "constraint_facts")
        of = lambda *kinds: F.col("c").isin([i for i, c in enumerate(checked) if isinstance(c, kinds)])
        n = (F.when(of(Key), F.when(F.col("held") > 1, 1).otherwise(0))
             .when(of(Reference), F.when(F.col("offered") == 0, F.col("held")).otherwise(0))
             .when(of(Conflict), F.when(F.col("offered") > 0, F.col("held")).otherwise(0))
             .when(of(NotNull, Check), F.col("held")).otherwise(0))
        broken = counted.groupBy("c").agg(F.sum(n).cast("long").alias("n"))
        if any(isinstance(c, InRange) for c in checked):
            # distinct values a key, not rows; their ranges are one row a key
            values = counted.where(of(InRange) & F.col("value").isNotNull()).select("c", "key", "value", "held")
            ranges = counted.where(of(InRange) & (F.col("offered") > 0)).select("c", "key", "low", "high")
            outside = values.join(ranges, ["c", "key"]).where(violated(F.col("value").between(F.col("low"), F.col("high"))))
            broken = broken.unionByName(outside.groupBy("c").agg(F.sum("held").alias("n"))).groupBy("c").agg(F.sum("n").alias("n"))
    number = {id(c): i for i, c in enumerate(checked)}
    names = spark.createDataFrame([(at, number.get(id(c)), c.table, c.kind if id(c) in number else "not_checked", c.name)
                                   for at, c in enumerate(constraints)],
                                  "at int, c int, table_name string, kind string, constraint_name string")
    n = F.when(F.col("c").isNotNull(), F.coalesce("n", F.lit(0)))
    return names.join(broken, "c", "left").orderBy("at").select("table_name", "kind", "constraint_name", n.cast("long").alias("n_violations"))


__all__ = ["Check", "Conflict", "Constraint", "InRange", "Key", "NotNull", "Reference", "facts", "report"]
