"""Arrays (R1, R2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def element(arr: Column | str, index: int | Column) -> Column:
    """1-based subscript; NULL outside the array (no error)."""
    i = index if isinstance(index, Column) else F.lit(index)
    return F.try_element_at(_c(arr), i)


def fixed_slots(arr: Column | str, n: int, fill: str = " ") -> Column:
    """An array padded with ``fill`` to exactly ``n`` slots; NULL stays NULL
    (the array type of a fixed-length ``VARCHAR(15)[5]`` column). An array of
    more than ``n`` elements breaks the type and raises; ``fits_slots`` is the
    rule that reports such rows."""
    a = _c(arr)
    pad = F.array_repeat(F.lit(fill), F.greatest(F.lit(n) - F.size(a), F.lit(0)))
    too_long = F.raise_error(F.concat(F.lit(f"array of more than {n} slots: "), F.size(a).cast("string")))
    return F.when(a.isNotNull(), F.when(F.size(a) > n, too_long.cast("array<string>")).otherwise(F.concat(a, pad)))


def fits_slots(arr: Column | str, n: int) -> Column:
    """TRUE for an array of at most ``n`` elements, unknown for NULL: the CHECK of a fixed-length array column."""
    return F.when(_c(arr).isNotNull(), F.size(_c(arr)) <= n)


def slot_value(arr: Column | str, slot: Column, blank_as: str = "NULL") -> Column:
    """R2's value of one 1-based slot: the element, the text ``blank_as`` for
    an element of blanks only, NULL past the end or for a NULL array."""
    v = F.try_element_at(_c(arr), slot)
    return F.when(F.trim(v) == "", F.lit(blank_as)).otherwise(v)


def array_slots(df: DataFrame, arr: str, n: int = 5, slot_col: str = "slot",
                value_col: str = "value", blank_as: str = "NULL") -> DataFrame:
    """R2: every row turned into exactly ``n`` rows, one per slot (1-based).

    A slot holding only blanks reads as the text ``blank_as``; a NULL array
    gives ``n`` rows with a NULL value (not the text); one of more than ``n``
    elements raises.
    """
    idx = F.sequence(F.lit(1), F.lit(n))
    rest = [c for c in df.columns if c != arr]
    checked = F.when(F.size(arr) > n, F.raise_error(F.lit(f"array of more than {n} slots")).cast(df.schema[arr].dataType)) \
               .otherwise(F.col(arr))
    out = df.select(*rest, checked.alias("__arr"), F.explode(idx).alias(slot_col))
    return out.withColumn(value_col, slot_value("__arr", F.col(slot_col), blank_as)).drop("__arr")
