"""Named domains (type + length + DEFAULT + CHECK) and named column rules, as a
registry the checks of ``rules`` draw on (C7).

A domain says what a column of that kind may hold; ``domain_rule(column,
name)`` turns it into a ``rules.Rule`` for one column of a DataFrame, so any
table can be checked against the same declarations. Spark enforces none of
this by itself (a cast to ``varchar(n)`` does not check ``n``), so the length
of a VARCHAR(n)/CHAR(n) domain is part of its rule.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowsmith.operators.rules import Rule

Check = Callable[[Column], Column]


@dataclass(frozen=True)
class Domain:
    name: str
    spark_type: str
    max_length: int | None = None
    default: object = None
    not_null: bool = False
    check: Check | None = None

    def predicate(self, c: Column) -> Column:
        """TRUE for a value the domain allows; NULL (unknown) passes as in
        SQL CHECK, unless the domain is NOT NULL."""
        parts = []
        if self.max_length is not None:
            parts.append(c.isNull() | (F.length(c) <= self.max_length))
        if self.check is not None:
            parts.append(self.check(c))
        if self.not_null:
            parts.append(c.isNotNull())
        pred = F.lit(True)
        for p in parts:
            pred = pred & p
        return pred


# The domains of the sample schema, in declaration order
# (name, type, length, DEFAULT, NOT NULL, CHECK).
DOMAINS: dict[str, Domain] = {d.name: d for d in (
    Domain("firstname", "string", 15),
    Domain("lastname", "string", 20),
    Domain("phonenumber", "string", 20),
    Domain("countryname", "string", 15),
    Domain("addressline", "string", 30),
    Domain("empno", "short"),
    Domain("deptno", "string", 3,
           check=lambda v: (v == "000") | ((v > "0") & (v <= "999")) | v.isNull()),
    Domain("projno", "string", 5, check=lambda v: v == F.upper(v)),
    Domain("custno", "int", check=lambda v: v > 1000),
    Domain("jobcode", "string", 5, check=lambda v: v > "99999"),
    Domain("jobgrade", "short", check=lambda v: v.between(0, 6)),
    Domain("salary", "decimal(10,2)", default=0, check=lambda v: v > 0),
    Domain("budget", "decimal(12,2)", default=50000, check=lambda v: (v > 10000) & (v <= 2000000)),
    Domain("prodtype", "string", 12, default="software", not_null=True,
           check=lambda v: v.isin("software", "hardware", "other", "N/A")),
    Domain("ponumber", "string", 8, check=lambda v: v.startswith("V")),
)}

# The column CHECK rules of the sample schema, in declaration order.
COLUMN_RULES: dict[str, Check] = {
    "fiscal_year": lambda v: v >= 1993,
    "percent_change": lambda v: v.between(-50, 50),
    "on_hold": lambda v: v.isNull() | (v == "*"),
    "order_status": lambda v: v.isin("new", "open", "shipped", "waiting"),
    "paid": lambda v: v.isin("y", "n"),
    "qty_ordered": lambda v: v >= 1,
    "total_value": lambda v: v >= 0,
    "discount": lambda v: (v >= 0) & (v <= 1),
}


def domain_rule(column: str | Column, domain: str, name: str | None = None) -> Rule:
    """The rule of ``domain`` applied to ``column`` (named ``domain(column)``)."""
    c = F.col(column) if isinstance(column, str) else column
    label = name or f"{domain}({column if isinstance(column, str) else 'expr'})"
    return Rule(label, DOMAINS[domain].predicate(c))


def column_rule(column: str | Column, rule: str, name: str | None = None) -> Rule:
    """A named column CHECK applied to ``column`` (named ``rule(column)``)."""
    c = F.col(column) if isinstance(column, str) else column
    label = name or f"{rule}({column if isinstance(column, str) else 'expr'})"
    return Rule(label, COLUMN_RULES[rule](c))
