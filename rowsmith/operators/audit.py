"""Audit rows for a changed value between two snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.functions.dates import ntz_literal
from rowsmith.functions.scalars import percent_change
from rowsmith.operators.changes import update_sequence


def audit_changes(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str,
                  as_of, user: str) -> DataFrame:
    """One audit row per key whose ``value`` differs between ``old`` and
    ``new``: (keys..., change_date, updater_id, old_value, new_value,
    percent_change).

    Like an AFTER UPDATE trigger testing ``old.v <> new.v``: a NULL on
    either side is not a change (no row); keys present in only one snapshot
    are not updates (inner join). ``percent_change`` is
    ``(new - old) * 100 / old`` in double (NULL when old is 0).
    ``as_of`` and ``user`` are parameters, not the clock and login.
    """
    keys = list(keys)
    o = old.select(*keys, F.col(value).alias("__old"))
    n = new.select(*keys, F.col(value).alias("__new"))
    changed = o.join(n, on=keys, how="inner").where(F.col("__old") != F.col("__new"))
    return changed.select(
        *keys,
        ntz_literal(as_of).alias("change_date"),
        F.lit(user).alias("updater_id"),
        F.col("__old").cast("double").alias("old_value"),
        F.col("__new").cast("double").alias("new_value"),
        percent_change(F.col("__old"), F.col("__new")).alias("percent_change"))


def audit_update(df: DataFrame, keys: Sequence[str], value: str, steps, as_of, user: str):
    """D1 in trigger form: apply the ordered updates ``steps`` (as
    ``changes.update_sequence``) and return (new snapshot, audit rows).

    The audit sees the old and the new value of the same row, like an AFTER
    UPDATE trigger, so it needs no join: one projection keeps the old value,
    the updates rewrite the column, a filter keeps the changed rows. No
    shuffle at all, against two for a diff of two snapshots. The rows are
    the same as ``audit_changes(df, new, ...)``.
    """
    keys = list(keys)
    tagged = update_sequence(df.withColumn("__old", F.col(value)), steps)
    new = tagged.drop("__old")
    changed = tagged.where(F.col("__old") != F.col(value))
    rows = changed.select(
        *keys,
        ntz_literal(as_of).alias("change_date"),
        F.lit(user).alias("updater_id"),
        F.col("__old").cast("double").alias("old_value"),
        F.col(value).cast("double").alias("new_value"),
        percent_change(F.col("__old"), F.col(value)).alias("percent_change"))
    return new, rows
