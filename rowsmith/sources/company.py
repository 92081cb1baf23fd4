"""The sample company schema as data: ten tables with types, NOT NULL,
DEFAULT, domains, keys, references and CHECK rules, plus their computed
columns and the contact view.

``load`` shapes incoming rows to a table (types, DEFAULTs of absent columns,
computed columns); ``constraint_report`` runs every declared constraint of
every table as a data-quality job (C1-C10) and returns one count row per
constraint. Nothing here enforces on write: Spark has no constraints, so the
declarations become checks.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsmith.functions.dates import days_between, ntz_literal
from rowsmith.functions.scalars import concat_null
from rowsmith.operators import constraints as cs
from rowsmith.operators.domains import COLUMN_RULES, DOMAINS
from rowsmith.sources.tables import load_with_defaults

C = F.col
NOW = "NOW"  # a DEFAULT that takes the load's ``as_of`` time


@dataclass(frozen=True)
class Col:
    name: str
    type: str
    not_null: bool = False
    domain: str | None = None
    rule: str | None = None  # a named column rule of ``domains.COLUMN_RULES``
    default: object = None


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Col, ...]
    primary_key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    references: tuple[tuple[tuple[str, ...], str, tuple[str, ...]], ...] = ()
    row_rules: tuple[tuple[str, Callable[[], Column]], ...] = ()
    computed: Mapping[str, Callable[[], Column]] = field(default_factory=dict)

    def schema(self) -> T.StructType:
        """Declared types; every field nullable, since NOT NULL is reported by
        ``constraint_report`` rather than refused at load."""
        return T.StructType([T.StructField(c.name, _type(c.type), True) for c in self.columns])

    def defaults(self, as_of: dt.datetime) -> dict[str, object]:
        out = {}
        for c in self.columns:
            d = c.default if c.default is not None else (DOMAINS[c.domain].default if c.domain else None)
            if d is not None:
                out[c.name] = as_of if d == NOW else d
        return out


def _type(name: str) -> T.DataType:
    simple = {"string": T.StringType(), "short": T.ShortType(), "int": T.IntegerType(),
              "double": T.DoubleType(), "float": T.FloatType(), "timestamp_ntz": T.TimestampNTZType(),
              "array<string>": T.ArrayType(T.StringType()), "array<int>": T.ArrayType(T.IntegerType())}
    if name in simple:
        return simple[name]
    if name.startswith("decimal("):
        p, s = name[8:-1].split(",")
        return T.DecimalType(int(p), int(s))
    raise ValueError(name)


# The ten tables of the sample schema, in declaration order, with
# their columns (type, NOT NULL, domain or column rule, DEFAULT), keys,
# references, table CHECKs and computed columns.
COMPANY: dict[str, Table] = {t.name: t for t in (
    Table("country", (
        Col("country", "string", True, "countryname"),
        Col("currency", "string", True)), ("country",)),
    Table("job", (
        Col("job_code", "string", True, "jobcode"),
        Col("job_grade", "short", True, "jobgrade"),
        Col("job_country", "string", True, "countryname"),
        Col("job_title", "string", True),
        Col("min_salary", "decimal(10,2)", True, "salary"),
        Col("max_salary", "decimal(10,2)", True, "salary"),
        Col("job_requirement", "string"),
        Col("language_req", "array<string>")),
        ("job_code", "job_grade", "job_country"),
        references=((("job_country",), "country", ("country",)),),
        row_rules=(("min_salary < max_salary", lambda: C("min_salary") < C("max_salary")),)),
    Table("department", (
        Col("dept_no", "string", True, "deptno"),
        Col("department", "string", True),
        Col("head_dept", "string", False, "deptno"),
        Col("mngr_no", "short", False, "empno"),
        Col("budget", "decimal(12,2)", False, "budget"),
        Col("location", "string"),
        Col("phone_no", "string", False, "phonenumber", default="555-1234")),
        ("dept_no",), unique=(("department",),),
        references=((("head_dept",), "department", ("dept_no",)), (("mngr_no",), "employee", ("emp_no",)))),
    Table("employee", (
        Col("emp_no", "short", True, "empno"),
        Col("first_name", "string", True, "firstname"),
        Col("last_name", "string", True, "lastname"),
        Col("phone_ext", "string"),
        Col("hire_date", "timestamp_ntz", True, default=NOW),
        Col("dept_no", "string", True, "deptno"),
        Col("job_code", "string", True, "jobcode"),
        Col("job_grade", "short", True, "jobgrade"),
        Col("job_country", "string", True, "countryname"),
        Col("salary", "decimal(10,2)", True, "salary")),
        ("emp_no",),
        references=((("dept_no",), "department", ("dept_no",)),
                    (("job_code", "job_grade", "job_country"), "job", ("job_code", "job_grade", "job_country"))),
        computed={"full_name": lambda: concat_null(C("last_name"), ", ", C("first_name"))}),
    Table("project", (
        Col("proj_id", "string", True, "projno"),
        Col("proj_name", "string", True),
        Col("proj_desc", "string"),
        Col("team_leader", "short", False, "empno"),
        Col("product", "string", True, "prodtype")),
        ("proj_id",), unique=(("proj_name",),),
        references=((("team_leader",), "employee", ("emp_no",)),)),
    Table("employee_project", (
        Col("emp_no", "short", True, "empno"),
        Col("proj_id", "string", True, "projno")),
        ("emp_no", "proj_id"),
        references=((("emp_no",), "employee", ("emp_no",)), (("proj_id",), "project", ("proj_id",)))),
    Table("proj_dept_budget", (
        Col("fiscal_year", "int", True, rule="fiscal_year"),
        Col("proj_id", "string", True, "projno"),
        Col("dept_no", "string", True, "deptno"),
        Col("quart_head_cnt", "array<int>"),
        Col("projected_budget", "decimal(12,2)", False, "budget")),
        ("fiscal_year", "proj_id", "dept_no"),
        references=((("dept_no",), "department", ("dept_no",)), (("proj_id",), "project", ("proj_id",)))),
    Table("salary_history", (
        Col("emp_no", "short", True, "empno"),
        Col("change_date", "timestamp_ntz", True, default=NOW),
        Col("updater_id", "string", True),
        Col("old_salary", "decimal(10,2)", True, "salary"),
        Col("percent_change", "double", True, rule="percent_change", default=0.0)),
        ("emp_no", "change_date", "updater_id"),
        references=((("emp_no",), "employee", ("emp_no",)),),
        computed={"new_salary": lambda: C("old_salary") + C("old_salary") * C("percent_change") / F.lit(100)}),
    Table("customer", (
        Col("cust_no", "int", True, "custno"),
        Col("customer", "string", True),
        Col("contact_first", "string", False, "firstname"),
        Col("contact_last", "string", False, "lastname"),
        Col("phone_no", "string", False, "phonenumber"),
        Col("address_line1", "string", False, "addressline"),
        Col("address_line2", "string", False, "addressline"),
        Col("city", "string"),
        Col("state_province", "string"),
        Col("country", "string", False, "countryname"),
        Col("postal_code", "string"),
        Col("on_hold", "string", rule="on_hold")),
        ("cust_no",),
        references=((("country",), "country", ("country",)),)),
    Table("sales", (
        Col("po_number", "string", True, "ponumber"),
        Col("cust_no", "int", True, "custno"),
        Col("sales_rep", "short", False, "empno"),
        Col("order_status", "string", True, rule="order_status", default="new"),
        Col("order_date", "timestamp_ntz", True, default=NOW),
        Col("ship_date", "timestamp_ntz"),
        Col("date_needed", "timestamp_ntz"),
        Col("paid", "string", rule="paid", default="n"),
        Col("qty_ordered", "int", True, rule="qty_ordered", default=1),
        Col("total_value", "decimal(9,2)", True, rule="total_value"),
        Col("discount", "float", True, rule="discount", default=0.0),
        Col("item_type", "string", False, "prodtype")),
        ("po_number",),
        references=((("cust_no",), "customer", ("cust_no",)), (("sales_rep",), "employee", ("emp_no",))),
        row_rules=(("ship_date >= order_date", lambda: C("ship_date") >= C("order_date")),
                   ("date_needed > order_date", lambda: C("date_needed") > C("order_date")),
                   ("shipped has ship_date", lambda: ~((C("order_status") == "shipped") & C("ship_date").isNull()))),
        computed={"aged": lambda: days_between("order_date", "ship_date")}),
)}


def load(df: DataFrame, table: str, as_of: dt.datetime) -> DataFrame:
    """S2 for a company table: declared types, DEFAULTs for absent columns
    (``NOW`` is ``as_of``), ``MM/DD/YY`` date text read, computed columns added."""
    t = COMPANY[table]
    defaults = t.defaults(as_of)
    cols = {c.name for c in t.columns}
    frame = df
    for name, value in defaults.items():  # timestamp defaults as zone-less literals
        if name not in df.columns and isinstance(value, dt.datetime):
            frame = frame.withColumn(name, ntz_literal(value))
    return load_with_defaults(frame, t.schema(), {k: v for k, v in defaults.items() if k in cols},
                              {name: build() for name, build in t.computed.items()}, mdy_pivot=50)


def phone_list(employee: DataFrame, department: DataFrame) -> DataFrame:
    """S3: the contact view (employee joined to its department)."""
    return (employee.join(department.select("dept_no", "location", "phone_no"), "dept_no")
                    .select("emp_no", "first_name", "last_name", "phone_ext", "location", "phone_no"))


def declared_constraints(names: Iterable[str]) -> list[cs.Constraint]:
    """Every declared constraint of the named tables, in declaration order, then the two rules across tables."""
    out: list[cs.Constraint] = []
    names = list(names)
    for name in names:
        t = COMPANY[name]
        out += [cs.NotNull(name, "not_null", c.name, c.name) for c in t.columns
                if c.not_null or c.domain and DOMAINS[c.domain].not_null]
        out.append(cs.Key(name, "primary_key", ",".join(t.primary_key), t.primary_key))
        out += [cs.Key(name, "unique", ",".join(u), u, null_is_distinct=True) for u in t.unique]
        out += [cs.Reference(name, "foreign_key", f"{','.join(cols)} -> {ref}", cols, ref, ref_cols) for cols, ref, ref_cols in t.references]
        for c in t.columns:
            if c.domain:
                out.append(cs.Check(name, "check", f"{c.name}:{c.domain}", DOMAINS[c.domain].predicate(C(c.name))))
            if c.rule:
                out.append(cs.Check(name, "check", f"{c.name}:{c.rule}", COLUMN_RULES[c.rule](C(c.name))))
        out += [cs.Check(name, "check", label, build()) for label, build in t.row_rules]
    if {"employee", "job"} <= set(names):
        keys = ("job_code", "job_grade", "job_country")
        out.append(cs.InRange("employee", "salary_range", "salary within job range", keys, "salary", "job", keys, "min_salary", "max_salary"))
    if {"sales", "customer"} <= set(names):
        out.append(cs.Conflict("sales", "on_hold", "shipped to a customer on hold", ("cust_no",), C("order_status") == "shipped",
                               "customer", ("cust_no",), C("on_hold") == "*"))
    return out


def constraint_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Every declared constraint of the given tables, checked: one row
    (table_name, kind, constraint_name, n_violations) per constraint, with one
    scan and one shuffle a table (``operators.constraints``).

    Kinds: not_null (C1), primary_key (C2), unique (C3), foreign_key (C4/C5;
    a self reference is C6), check (domain, column and row rules, C7/C8;
    unknown passes), salary_range (C9), on_hold (C10). ``n_violations``
    counts NULL values for not_null, duplicated key values for primary_key
    and unique, and offending rows for every other kind. A reference to a
    table that is not given has the kind ``not_checked`` and no count.
    """
    return cs.report(tables, declared_constraints(tables))
