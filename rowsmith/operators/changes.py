"""Table-change jobs (M1-M7): a new snapshot out, the input left untouched.

Each job is one lazy plan over the input; a series of changes is a fold of
Column rewrites, so nothing is materialised between steps. The exception is
key assignment (M7): numbering rows needs their sorted order fixed once, so
it goes through ``positions.with_position`` (one reliable checkpoint).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowsmith.operators.generator import KeyGenerator
from rowsmith.operators.positions import with_position
from rowsmith.operators.skew import join_unique, split_by_keys
from rowsmith.session import require_all_unique, require_unique, stored


def update_where(df: DataFrame, column: str, predicate: Column, value: Column | object) -> DataFrame:
    """M1: ``UPDATE t SET column = value WHERE predicate``. Rows where the
    predicate is unknown are not updated."""
    v = value if isinstance(value, Column) else F.lit(value)
    return df.withColumn(column, F.when(F.coalesce(predicate, F.lit(False)), v).otherwise(F.col(column)))


def update_sequence(df: DataFrame, steps: Sequence[tuple[str, Column, Column | object]]) -> DataFrame:
    """M2: ordered UPDATEs; a later step sees what earlier steps wrote.
    ``steps`` are (column, predicate, value) with expressions over the
    current columns; they fold into one projection chain."""
    for column, predicate, value in steps:
        df = update_where(df, column, predicate, value)
    return df


def update_by_mapping(df: DataFrame, key: str, mapping: DataFrame, mapping_key: str,
                      assignments: dict[str, str]) -> DataFrame:
    """M3: ``UPDATE t SET col = m.val WHERE t.key = m.key`` for a whole table
    of (key, value) pairs. ``assignments`` maps a target column to a mapping
    column. Rows with no mapping row keep their values; a mapping row whose
    value is NULL does write NULL. A ``mapping`` that holds a key twice raises."""
    require_unique(mapping, [mapping_key], "the mapping")
    m = mapping.select(F.col(mapping_key).alias("__mk"), F.lit(True).alias("__hit"),
                       *[F.col(src).alias("__m_" + dst) for dst, src in assignments.items()])
    joined = df.join(m, df[key] == m["__mk"], "left")
    for dst in assignments:
        joined = joined.withColumn(dst, F.when(F.col("__hit"), F.col("__m_" + dst)).otherwise(F.col(dst)))
    return joined.drop("__mk", "__hit", *["__m_" + d for d in assignments])


def null_out_references(df: DataFrame, ref_col: str, removed: DataFrame, removed_key: str,
                        changed_col: str | None = None) -> DataFrame:
    """M4: set ``ref_col`` to NULL where it points at a removed key. With
    ``changed_col``, a boolean column marks the rows this job cleared.

    Rows without a reference pass by the join; the others are split by a semi
    and an anti join, which ignore repeats in ``removed``, so no aggregate
    stands under a join and a hot key can be split at runtime."""
    r = removed.select(F.col(removed_key).alias("__rk"))
    on = df[ref_col] == r["__rk"]
    null = F.lit(None).cast(df.schema[ref_col].dataType)
    hit = df.join(r, on, "left_semi").withColumn(ref_col, null)
    rest = df.where(F.col(ref_col).isNull()).unionByName(df.where(F.col(ref_col).isNotNull()).join(r, on, "left_anti"))
    if changed_col:
        hit, rest = hit.withColumn(changed_col, F.lit(True)), rest.withColumn(changed_col, F.lit(False))
    return rest.unionByName(hit)


def cascade_delete(parent: DataFrame, parent_key: str, keys: DataFrame, key_col: str,
                   blockers: DataFrame, blocker_key: str,
                   children: dict[str, tuple[DataFrame, str, str]]):
    """M5: delete a set of parent keys with a guard.

    A key that still has a row in ``blockers`` is refused (reason
    ``has_blocking_rows``) and nothing of it changes. For the accepted keys:
    the parent rows go, and each child in ``children`` (name -> (frame,
    reference column, action)) is handled by ``action``: ``'delete'`` drops
    the rows, ``'nullify'`` sets the reference to NULL and marks those rows
    in a boolean column ``cleared``.

    Returns (new parent, {name: new child}, refused keys with reason,
    accepted keys). The key sets are distinct and map-side combined. The
    accepted set is the result of a join, so it is stored, and each child's hot
    references are measured and changed without a shuffle (``skew.split_by_keys``):
    children that mostly refer to one parent do not meet in one task.
    """
    wanted = keys.select(F.col(key_col).alias("__k")).distinct()
    blocked = blockers.select(F.col(blocker_key).alias("__k")).distinct()
    refused = (wanted.join(blocked, "__k", "left_semi")
                     .select(F.col("__k").alias(key_col), F.lit("has_blocking_rows").alias("reason")))
    accepted = stored(wanted.join(blocked, "__k", "left_anti"), "accepted_keys")
    new_parent = parent.join(accepted, parent[parent_key] == accepted["__k"], "left_anti")
    new_children = {}
    for name, (frame, ref, action) in children.items():
        if action not in ("delete", "nullify"):
            raise ValueError(f"unknown action {action!r}")
        hit, rest = split_by_keys(frame, accepted.withColumnRenamed("__k", ref), [ref])
        if action == "nullify":
            hit = hit.withColumn(ref, F.lit(None).cast(frame.schema[ref].dataType)).withColumn("cleared", F.lit(True))
            rest = rest.withColumn("cleared", F.lit(False)).unionByName(hit)
        new_children[name] = rest.select(*frame.columns, *(["cleared"] if action == "nullify" else []))
    return new_parent, new_children, refused, accepted.select(F.col("__k").alias(key_col))


def insert_tagged(new_rows: DataFrame, parents: dict[str, tuple[str, DataFrame, str]],
                  existing: DataFrame | None = None, key: Sequence[str] | None = None,
                  order_by: Sequence[Column | str] | None = None) -> DataFrame:
    """M6: the rows to insert with ``status``: ``accepted`` or the reason of refusal.

    ``parents`` maps a reason suffix to (reference column, parent frame,
    parent key); a non-NULL reference with no parent row gives
    ``unknown_<suffix>``. With ``existing`` and ``key``, rows are inserted one
    by one in ``order_by`` order (all columns by default): the first row of a
    key that passes the parent tests and is not present yet is accepted, later
    ones give ``duplicate_key``. A row refused for its parent does not block
    others of its key. A key with a NULL part is never a duplicate.

    A parent key that occurs twice raises: so every test is one left join with
    a plain table, and a hot key can be split at runtime. The first row of each
    key is a map-side combined minimum, so a key with a third of the rows sends
    one row a task; rows then find their key's first one by ``skew.join_unique``.
    Names in ``order_by`` are ascending with NULLs first, Columns may carry
    another direction; rows equal in all of them come in no stated order.
    """
    tagged, failed = new_rows, F.lit(None).cast("string")
    unique = [(parent, [pkey], f"the parent table of {suffix}") for suffix, (_, parent, pkey) in parents.items()]
    if existing is not None and key:
        unique.append((existing, list(key), "the table"))
    require_all_unique(unique)
    for suffix, (ref, parent, pkey) in parents.items():
        p = parent.select(F.col(pkey).alias("__p"), F.lit(True).alias("__ok"))
        tagged = tagged.join(p, tagged[ref] == p["__p"], "left")
        failed = F.coalesce(failed, F.when(F.col(ref).isNotNull() & F.col("__ok").isNull(), F.lit(f"unknown_{suffix}")))
        tagged = tagged.withColumn("__failed", failed).drop("__p", "__ok")
        failed = F.col("__failed")
    tagged = tagged.withColumn("__failed", failed)
    status = F.col("__failed")
    if existing is not None and key:
        key = list(key)
        have = existing.select(*key, F.lit(True).alias("__have"))
        tagged = tagged.join(have, on=key, how="left")
        whole = F.lit(True)
        for k in key:
            whole = whole & F.col(k).isNotNull()
        # a number of their own tells equal rows apart; the stored table fixes it for both reads below
        tagged = stored(tagged.select(*new_rows.columns, "__failed", F.coalesce("__have", F.lit(False)).alias("__have"),
                                      F.monotonically_increasing_id().alias("__row")), "insert_rows")
        valid = tagged.where(whole & F.col("__failed").isNull() & ~F.col("__have"))
        if all(isinstance(c, str) for c in order_by or []):
            least = F.struct(*(order_by or new_rows.columns), "__row")
            first = valid.groupBy(*key).agg(F.min(least).alias("__o")).select(*key, F.col("__o.__row").alias("__first"))
        else:  # a Column may carry a sort direction, which a minimum cannot follow: each task keeps one row a key
            rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order_by, "__row"))
            first = valid.withColumn("__n", rank).where("__n = 1").select(*key, F.col("__row").alias("__first"))
        tagged = join_unique(tagged.where(whole), first, key, "left").unionByName(
            tagged.where(~whole).withColumn("__first", F.col("__row")))
        again = F.col("__have") | (F.col("__row") != F.col("__first"))
        status = F.coalesce(status, F.when(again, F.lit("duplicate_key")))
    return tagged.select(*new_rows.columns, F.coalesce(status, F.lit("accepted")).alias("status"))


def insert_checked(new_rows: DataFrame, parents: dict[str, tuple[str, DataFrame, str]],
                   existing: DataFrame | None = None, key: Sequence[str] | None = None,
                   order_by: Sequence[Column | str] | None = None):
    """M6 as two frames: (accepted rows, rejected rows with ``reason``). See ``insert_tagged``."""
    tagged = insert_tagged(new_rows, parents, existing, key, order_by)
    return (tagged.where(F.col("status") == "accepted").drop("status"),
            tagged.where(F.col("status") != "accepted").withColumnRenamed("status", "reason"))


def assign_keys(df: DataFrame, key: str, order_by: Sequence[Column | str], start_after: int | None = None,
                generator: KeyGenerator | None = None, run: str | None = None) -> DataFrame:
    """M7: fill a NULL key from a sequence: ``mark + 1``, ``mark + 2``, ... in
    ``order_by`` order among the NULL-key rows; a key already given is kept.

    With a ``generator`` the keys are a range that it reserves for ``run``:
    a key is never given twice, also when the rows that held the highest keys
    are gone by the next load, and a load that is run again under its name gives
    the same keys. Keys of ``df`` above the generator's mark move it first.
    Without one, ``mark`` is ``start_after`` when given, else the high-water mark
    ``max(key)`` of the rows that have a key (0 if none). The numbering is the
    distributed one of ``positions.with_position``."""
    have = df.where(F.col(key).isNotNull())
    missing = df.where(F.col(key).isNull())
    if start_after is None:
        # two scalars (the high-water mark and the number of keys wanted) come to the driver, no rows
        mark, wanted = df.agg(F.coalesce(F.max(key), F.lit(0)).cast("long"), F.count_if(F.col(key).isNull())).first()
        start_after = mark
        if generator is not None:
            generator.advance_to(mark)
            start_after = generator.reserve(wanted, run) - 1
    elif generator is not None:
        raise ValueError("start_after and a generator cannot both give the keys")
    numbered = with_position(missing, order_by, "__pos", start=int(start_after) + 1)
    filled = numbered.withColumn(key, F.col("__pos").cast(df.schema[key].dataType)).drop("__pos")
    return have.unionByName(filled)
