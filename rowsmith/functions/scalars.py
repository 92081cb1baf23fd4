"""Scalar Column functions (X1, X2, X6-X10). All JVM-side expressions."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def concat_null(*parts: Column | str) -> Column:
    """SQL ``||``: NULL if any part is NULL (``concat``, not ``concat_ws``).
    Plain strings are literals here; wrap column names in ``F.col``."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def is_upper(c: Column | str) -> Column:
    """``value = UPPER(value)`` (NULL stays unknown)."""
    c = _c(c)
    return c == F.upper(c)


def case_chain(branches: Sequence[tuple[Column, Column | object]], otherwise=None) -> Column:
    """IF / ELSE IF chain; the first TRUE test wins (NULL tests fall through)."""
    expr = None
    for cond, value in branches:
        value = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    if otherwise is not None:
        expr = expr.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))
    return expr


def raise_by_percent(amount: Column | str, percent, scale: int = 2,
                     result_type: str = "decimal(12,2)") -> Column:
    """``amount + amount * percent / 100`` in exact decimal arithmetic,
    rounded half up to ``scale`` places (an explicit rounding, not a cast).

    A fixed ``percent`` becomes the exact factor ``1 + percent / 100`` (a
    decimal literal of its own precision), so the product is exact before
    the one rounding."""
    a = _c(amount)
    if isinstance(percent, Column):
        return F.round(a + a * percent / F.lit(100), scale).cast(result_type)
    factor = Decimal(1) + Decimal(str(percent)) / Decimal(100)
    # the narrowest decimal that holds the factor keeps amount x factor within
    # 18 digits (Spark's 64-bit decimal path) for the usual money types
    frac = max(0, -factor.normalize().as_tuple().exponent)
    whole = max(1, len(str(abs(int(factor)))))
    return F.round(a * F.lit(str(factor)).cast(f"decimal({whole + frac},{frac})"), scale).cast(result_type)


def percent_change(old: Column | str, new: Column | str) -> Column:
    """``(new - old) * 100 / old`` in double; NULL when old is 0 or NULL."""
    o, n = _c(old).cast("double"), _c(new).cast("double")
    return (n - o) * F.lit(100.0) / F.when(o != 0, o)


def int_add(a: Column | str, b: Column | str) -> Column:
    """Sum of two integers, widened to long first so it cannot overflow."""
    return _c(a).cast("long") + _c(b).cast("long")


def int_sub(a: Column | str, b: Column | str) -> Column:
    """Difference of two integers, widened to long first."""
    return _c(a).cast("long") - _c(b).cast("long")


def int_double(a: Column | str) -> Column:
    """An integer times two, widened to long first."""
    return _c(a).cast("long") * F.lit(2)
