"""Reports (B1-B6): whole procedures as table jobs, built from the operators.

Each report is one lazy plan: the procedural loops of the original (a
look-up per row, a count per department, a check per order) become joins
and one aggregation over the whole table.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.functions import arrays, dates
from rowsmith.functions.scalars import case_chain, concat_null
from rowsmith.operators import aggregates, joins, predicates
from rowsmith.session import stored

C = F.col

# The fallback manager name of an unmanaged unit, and the
# separator row placed after each group of a slot listing (code, grade,
# country, value).
NO_MANAGER = "--TBH--"
SEPARATOR_CODE = "====="
SEPARATOR_GRADE = "====="
SEPARATOR_COUNTRY = "==============="
SEPARATOR_VALUE = "=============="

# The ship decisions, in the order their tests run.
ALREADY_SHIPPED, ON_HOLD, OVERDUE, SHIP = "already_shipped", "on_hold", "overdue", "ship"


def phone_list(view: DataFrame, location: str, columns: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """B1: the rows of one location from the contact view, projected and
    sorted (the filter is pushed below the view's join by Catalyst)."""
    return predicates.filter_eq(view, "location", location).select(*columns).orderBy(*order_by)


def org_chart(units: DataFrame, managers: DataFrame, staff: DataFrame) -> DataFrame:
    """B2: one row per unit, ordered by unit key.

    ``units``: (node, parent, name); ``managers``: (dept_no, mngr_no);
    ``staff``: (emp_no, dept_no, full_name, job_code). Output (dept_no,
    head_dept, department, mngr_name, title, emp_cnt): the parent unit's name
    (NULL for a root), the manager's name and job or ``--TBH--`` and '' when
    the unit has none, and the head count (0 for an empty unit).
    """
    # joins keyed by the unit first (head count, manager link): one
    # partitioning on the unit key serves both; outer joins are not reordered
    # by the optimizer, so the order here is the plan's order
    counted = aggregates.count_with_zero(units, "node", staff.select("dept_no"), "dept_no", "emp_cnt")
    with_mgr = counted.join(managers, counted["node"] == managers["dept_no"], "left").drop("dept_no")
    heads = units.select(C("node").alias("__head_key"), C("name").alias("head_dept"))
    with_head = (with_mgr.join(heads, with_mgr["parent"] == heads["__head_key"], "left")
                         .drop("__head_key"))
    looked = joins.join_lookup_default(with_head, staff.select("emp_no", "full_name", "job_code"),
                                       "mngr_no", "emp_no",
                                       {"mngr_name": ("full_name", NO_MANAGER), "title": ("job_code", "")})
    return (looked.select(C("node").alias("dept_no"), "head_dept", C("name").alias("department"),
                          "mngr_name", "title", "emp_cnt")
                  .orderBy("dept_no"))


def mail_label_lines(customer: Column, first: Column, last: Column, addr1: Column, addr2: Column,
                     city: Column, state: Column, country: Column, postcode: Column) -> list[Column]:
    """The six label lines of one contact, with SQL ``||`` semantics (a
    NULL part makes the line NULL). Lines start as ''. The USA layout puts
    city, state and postcode on line 5 and leaves line 6 ''; any other
    country (or none: unknown is not 'USA') gets city and state on line 5
    and country and postcode on line 6."""
    usa = F.coalesce(country == "USA", F.lit(False))
    line1 = F.coalesce(customer, F.lit(""))
    line2 = F.when(first.isNotNull(), concat_null(first, " ", last)).otherwise(last)
    line3 = F.coalesce(addr1, F.lit(""))
    line4 = F.coalesce(addr2, F.lit(""))
    line5 = F.when(usa, F.when(city.isNotNull(), concat_null(city, ", ", state, "  ", postcode))
                          .otherwise(concat_null(state, "  ", postcode))) \
             .otherwise(F.when(city.isNotNull(), concat_null(city, ", ", state)).otherwise(state))
    line6 = F.when(usa, F.lit("")).otherwise(concat_null(country, "    ", postcode))
    return [line1, line2, line3, line4, line5, line6]


def mail_labels(contacts: DataFrame, key: str) -> DataFrame:
    """B3 for every contact row: (key, line1..line6)."""
    lines = mail_label_lines(*[C(c) for c in ("customer", "contact_first", "contact_last", "address_line1",
                                               "address_line2", "city", "state_province", "country",
                                               "postal_code")])
    return contacts.select(key, *[ln.alias(f"line{i}") for i, ln in enumerate(lines, 1)])


def ship_decisions(sales: DataFrame, customers: DataFrame, as_of: dt.datetime, grace_days: int = 60) -> DataFrame:
    """The decision for every order, tests in this order: already shipped;
    customer on hold; customer overdue (any of their shipped, unpaid orders
    shipped before ``as_of - grace_days``); else ship.

    ``sales``: (o_orderkey, o_custkey, order_status, ship_date, paid);
    ``customers``: (c_custkey, on_hold), each once. What is known of a customer
    (on hold, overdue) is one small row, map-side combined and stored; orders
    not shipped yet are joined with it once, a join that can be split for a hot
    customer. Shipped orders need no join.
    An order whose customer is not in ``customers`` is judged on its own
    status (it cannot be on hold); a per-order look-up through an inner join
    would see no status at all for it. A NULL ship date is never overdue.
    """
    shipped = C("order_status").eqNullSafe("shipped")
    status = _customer_status(sales, customers, as_of, grace_days)
    waiting = sales.where(~shipped)
    judged = waiting.join(status, waiting["o_custkey"] == status["__ck"], "left").withColumn(
        "decision", case_chain([(C("__held"), ON_HOLD), (C("__overdue"), OVERDUE)], SHIP))
    done = sales.where(shipped).withColumn("decision", F.lit(ALREADY_SHIPPED))
    return (judged.select("o_orderkey", "o_custkey", "decision")
            .unionByName(done.select("o_orderkey", "o_custkey", "decision")))


def _customer_status(sales: DataFrame, customers: DataFrame, as_of: dt.datetime, grace_days: int) -> DataFrame:
    cutoff = dates.minus_days(as_of, grace_days)
    overdue = (sales.where((C("order_status") == "shipped") & (C("paid") == "n") & (C("ship_date") < cutoff))
                    .select(C("o_custkey").alias("__ck"), F.lit(False).alias("__held"), F.lit(True).alias("__overdue")))
    held = (customers.where(C("on_hold") == "*")
                     .select(C("c_custkey").alias("__ck"), F.lit(True).alias("__held"), F.lit(False).alias("__overdue")))
    known = held.unionByName(overdue).groupBy("__ck").agg(F.max("__held").alias("__held"), F.max("__overdue").alias("__overdue"))
    return stored(known, "customer_status")


def shipped_sales(sales: DataFrame, customers: DataFrame, as_of: dt.datetime, grace_days: int = 60) -> DataFrame:
    """B4, the write half: the new snapshot of ``sales`` after shipping every
    order the decision allows. Such an order becomes shipped with ``as_of`` as
    its ship date; all others keep their row. The same one join decides."""
    shipped = C("order_status").eqNullSafe("shipped")
    status = _customer_status(sales, customers, as_of, grace_days)
    waiting = sales.where(~shipped)
    stays = F.coalesce(C("__held") | C("__overdue"), F.lit(False))
    changed = (waiting.join(status, waiting["o_custkey"] == status["__ck"], "left")
               .withColumn("ship_date", F.when(stays, C("ship_date")).otherwise(dates.ntz_literal(as_of)))
               .withColumn("order_status", F.when(stays, C("order_status")).otherwise("shipped")))
    return changed.select(*sales.columns).unionByName(sales.where(shipped))


def slots_with_separators(df: DataFrame, group_key: str, code: Column, grade: Column, country: Column,
                          arr: str, n: int = 5) -> DataFrame:
    """For every row, its ``n`` array slots (R2), then a separator row.

    Output (group_key, seq, code, grade, country, value): seq 1..n are the
    slots, seq n+1 the separator (fixed text in every column), so sorting on
    (group_key, seq) gives the listing with a separator after each group.
    One pass: a single generator emits the n slots and the separator row.
    """
    rows = df.select(C(group_key), code.alias("__code"), grade.alias("__grade"), country.alias("__country"),
                     C(arr).alias("__arr"), F.explode(F.sequence(F.lit(1), F.lit(n + 1))).alias("seq"))
    sep = C("seq") == n + 1
    return rows.select(
        group_key, "seq",
        F.when(sep, F.lit(SEPARATOR_CODE)).otherwise(C("__code")).alias("code"),
        F.when(sep, F.lit(SEPARATOR_GRADE)).otherwise(C("__grade")).alias("grade"),
        F.when(sep, F.lit(SEPARATOR_COUNTRY)).otherwise(C("__country")).alias("country"),
        F.when(sep, F.lit(SEPARATOR_VALUE)).otherwise(arrays.slot_value("__arr", C("seq"))).alias("value"))


def assignments(link: DataFrame, link_key: str, keys: DataFrame, key_col: str,
                columns: Sequence[str]) -> DataFrame:
    """The link-table rows of the given keys (a semi join with the key
    set, of any size), distinct on ``columns``. Rows are made distinct, map-side
    combined, before the join, so a hot key sends few rows to it."""
    wanted = list(dict.fromkeys([link_key, *columns]))
    found = joins.join_semi(link.select(*wanted).distinct(), keys.select(C(key_col).alias(link_key)), [link_key])
    return found.select(*columns) if set(wanted) == set(columns) else found.select(*columns).distinct()
