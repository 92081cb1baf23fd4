"""Constraints in one scan a table: equal to the job for each, hot keys included."""

import random

from pyspark.sql import functions as F

from helpers import rows
from rowsmith.operators import constraints as cs, rules
from rowsmith.operators.domains import COLUMN_RULES, DOMAINS
from rowsmith.sources import company

C = F.col


def one_by_one(tables):
    """The company report with a job for each constraint."""
    out = []
    for name, df in tables.items():
        t = company.COMPANY[name]
        nn = [c.name for c in t.columns if c.not_null or c.domain and DOMAINS[c.domain].not_null]
        out += [(name, "not_null", r["column_name"], r["n_null"]) for r in rules.null_counts(df, nn).collect()]
        out.append((name, "primary_key", ",".join(t.primary_key), rules.duplicate_keys(df, t.primary_key).count()))
        out += [(name, "unique", ",".join(u), rules.duplicate_keys(df, u, null_is_distinct=True).count()) for u in t.unique]
        for cols, ref, ref_cols in t.references:
            label = f"{','.join(cols)} -> {ref}"
            out.append((name, "foreign_key", label, rules.orphans(df, list(cols), tables[ref], list(ref_cols)).count())
                       if ref in tables else (name, "not_checked", label, None))
        checks = []
        for c in t.columns:
            checks += [rules.Rule(f"{c.name}:{c.domain}", DOMAINS[c.domain].predicate(C(c.name)))] if c.domain else []
            checks += [rules.Rule(f"{c.name}:{c.rule}", COLUMN_RULES[c.rule](C(c.name)))] if c.rule else []
        checks += [rules.Rule(label, build()) for label, build in t.row_rules]
        if checks:
            out += [(name, "check", r["rule"], r["n_violations"]) for r in rules.rule_counts(df, checks).collect()]
    if {"employee", "job"} <= set(tables):
        out.append(("employee", "salary_range", "salary within job range", rules.range_violations(
            tables["employee"], tables["job"], ["job_code", "job_grade", "job_country"], "salary", "min_salary", "max_salary").count()))
    if {"sales", "customer"} <= set(tables):
        out.append(("sales", "on_hold", "shipped to a customer on hold", rules.cross_table(
            tables["sales"], C("order_status") == "shipped", tables["customer"], C("on_hold") == "*", ["cust_no"]).count()))
    return sorted(map(str, out))


def company_tables(spark, rng, names, n=60):
    """Random rows with broken keys, references, NULLs and rules of all kinds."""
    def value(c):
        if rng.random() < 0.08:
            return None
        kind = c.type.split("(")[0]
        if kind in ("short", "int"):
            return rng.randrange(0, 12)
        if kind == "decimal":
            return rng.randrange(0, 90_000)
        if kind in ("double", "float"):
            return rng.random() * 2 - 0.5
        if kind == "timestamp_ntz":
            return f"20{rng.randrange(10, 30)}-01-0{rng.randrange(1, 9)}"
        if kind.startswith("array"):
            return None
        return rng.choice(["000", "100", "A", "B", "Engineer", "VWXYZ", "shipped", "new", "y", "n", "*", "USA", "V9", "N/A", "software"])
    out = {}
    for name in names:
        t = company.COMPANY[name]
        plain = ", ".join(f"{c.name} {'string' if not c.type.startswith('array') else c.type}" for c in t.columns)
        data = [tuple(None if (v := value(c)) is None else str(v) for c in t.columns) for _ in range(n)]
        df = spark.createDataFrame(data, plain)
        out[name] = df.select(*[C(f.name).try_cast(f.dataType).alias(f.name) for f in t.schema().fields])
    return out


def report_rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_equals_a_job_for_each_constraint(spark):
    rng = random.Random(5)
    tables = company_tables(spark, rng, list(company.COMPANY))
    got = report_rows(company.constraint_report(tables))
    assert got == one_by_one(tables)
    assert sum(not r.endswith(", 0)") for r in got) > 40  # most constraints are broken somewhere


def test_tables_not_given_are_not_checked(spark):
    tables = company_tables(spark, random.Random(6), ["employee", "sales", "department"])
    assert report_rows(company.constraint_report(tables)) == one_by_one(tables)
    empty = {k: v.limit(0) for k, v in tables.items()}
    assert {r["n_violations"] for r in company.constraint_report(empty).collect()} == {0, None}


def test_one_scan_and_one_shuffle_a_table(spark, tmp_path):
    tables = company_tables(spark, random.Random(7), ["employee", "department", "job", "country"])
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}")
    tables = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in tables}
    declared = company.declared_constraints(tables)
    plan = cs.facts(tables, declared)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert plan.count("FileScan") == 4 and plan.count("Exchange") == 1 and "partial_sum" in plan and "Join" not in plan
    assert len(declared) > 30


def test_a_hot_key_is_one_partial_count_a_task(spark):
    child = spark.range(40_000).select(C("id"), F.when(C("id") % 3 == 0, 0).otherwise(C("id") % 700).alias("k")).repartition(6)
    parent = spark.range(1, 500).select(C("id").alias("p"))
    wanted = [cs.Reference("child", "fk", "k", ("k",), "parent", ("p",)), cs.Key("child", "pk", "id", ("id",)),
              cs.Conflict("child", "no", "k", ("k",), C("id") < 1000, "parent", ("p",), C("p") > 490),
              cs.InRange("child", "range", "id", ("k",), "id", "parent", ("p",), "p", "p")]
    data = [(i, 0 if i % 3 == 0 else i % 700) for i in range(40_000)]
    want = [sum(not 1 <= k < 500 for _, k in data), 0, sum(i < 1000 and 490 < k < 500 for i, k in data),
            sum(1 <= k < 500 and i != k for i, k in data)]
    tables = {"child": child, "parent": parent}
    assert [r["n_violations"] for r in cs.report(tables, wanted).collect()] == want
    # rows that leave the map side: one a task for each key, not one a row
    counted = cs.facts(tables, wanted[:1])
    assert counted.where("held > 10000").count() == 1
    assert rows(counted.agg(F.sum("held"))) == [(40_000,)]
