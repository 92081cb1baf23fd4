"""The jobs on the sample company schema itself, with invented rows covering
the fixture cases (FIXTURES.md §A): a 4-level unit tree, a unit without a
manager and one without people, two people with one last name, a NULL phone
extension, a name with a quote and one with a blank, salaries below, inside
and above their range and a job key with no range row, arrays that are NULL,
blank, partly blank and full, one row breaking each rule."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rowsmith.operators import aggregates, audit, changes, hierarchy, rules
from rowsmith.plans import reports
from rowsmith.sources import company

C = F.col
AS_OF = dt.datetime(2000, 3, 1)


def _load(spark, table, rows, ddl):
    return company.load(spark.createDataFrame(rows, ddl), table, AS_OF)


@pytest.fixture(scope="module")
def db(spark):
    t = {}
    t["country"] = _load(spark, "country", [("Freedonia", "Fred"), ("Sylvania", "Syl"), ("USA", "Dollar")],
                         "country string, currency string")
    t["job"] = _load(spark, "job", [
        ("Eng", 2, "USA", "Engineer", "50000", "90000", ["English", " ", " ", " ", " "]),
        ("Mgr", 1, "USA", "Manager", "70000", "150000", None),
        ("Sales", 3, "Freedonia", "Seller", "30000", "60000", [" ", " ", " ", " ", " "]),
        ("Admin", 5, "Sylvania", "Clerk", "40000", "40000", ["Sylvan", "English", "Fredish", "Latin", "Greek"]),
        ("1bad", 7, "Atlantis", "Odd", "10", "5", None),
    ], "job_code string, job_grade int, job_country string, job_title string, min_salary string, "
       "max_salary string, language_req array<string>")
    t["department"] = _load(spark, "department", [
        ("000", "Corporate", None, 1, "1000000", "Harbor"),
        ("100", "Sales", "000", 2, "500000", "Harbor"),
        ("110", "Field Sales", "100", None, "200000", "Uplands"),
        ("111", "Field East", "110", None, "50000", "Uplands"),
        ("200", "Lab", "000", 3, "800000", "Harbor"),
        ("300", "Empty Unit", "000", None, None, "Uplands"),
    ], "dept_no string, department string, head_dept string, mngr_no int, budget string, location string")
    t["employee"] = _load(spark, "employee", [
        (1, "Ann", "Okafor", "101", "000", "Mgr", 1, "USA", "120000"),
        (2, "Bo", "Okafor", "102", "100", "Mgr", 1, "USA", "80000"),
        (3, "Cy", "O'Neil", None, "200", "Eng", 2, "USA", "95000"),
        (4, "Di", "van Dam", "104", "100", "Sales", 3, "Freedonia", "25000"),
        (5, "Ed", "Lindqvist", "105", "110", "Sales", 3, "Freedonia", "45000"),
        (6, "Flo", "Alvarez", "106", "111", "Eng", 9, "USA", "60000"),
    ], "emp_no int, first_name string, last_name string, phone_ext string, dept_no string, job_code string, "
       "job_grade int, job_country string, salary string")
    t["project"] = _load(spark, "project", [
        ("ALPHA", "Alpha", None, 2, "software"), ("beta", "Beta", None, 3, "hardware"),
        ("GAMMA", "Gamma", None, None, "gadget"),
    ], "proj_id string, proj_name string, proj_desc string, team_leader int, product string")
    t["employee_project"] = _load(spark, "employee_project", [
        (1, "ALPHA"), (2, "ALPHA"), (3, "beta"), (5, "GAMMA"), (9, "ALPHA")], "emp_no int, proj_id string")
    t["customer"] = _load(spark, "customer", [
        (1001, "Acme", "Ann", "Lee", "1 Main", None, "Reno", "NV", "USA", "89501", None),
        (1002, "Bolt", None, "Kim", "2 Side", "Suite 4", None, "CA", "USA", "90001", "*"),
        (1003, "Cog", "Bo", None, "3 Rue", None, "Fredville", None, "Freedonia", "F-1", None),
        (1004, "Dyn", "Cy", "Ng", None, None, "Oslo", "Ost", "Sylvania", None, None),
        (999, "Tiny", None, None, None, None, None, None, "USA", None, None),
    ], "cust_no int, customer string, contact_first string, contact_last string, address_line1 string, "
       "address_line2 string, city string, state_province string, country string, postal_code string, "
       "on_hold string")
    t["sales"] = _load(spark, "sales", [
        ("V001", 1001, 2, "shipped", "2000-01-01", "2000-01-05", None, "y", 1, "100", 0.0, "software"),
        ("V002", 1001, 2, "open", "2000-02-01", None, None, "n", 1, "100", 0.0, "software"),
        ("V003", 1002, 4, "shipped", "1999-12-01", "1999-12-02", None, "n", 2, "50", 0.1, "software"),
        ("V004", 1002, 4, "open", "2000-02-01", None, None, "n", 1, "10", 0.0, "software"),
        ("V005", 1003, 5, "shipped", "1999-12-01", "1999-12-31", None, "n", 1, "10", 0.0, "hardware"),
        ("V006", 1003, 5, "waiting", "2000-02-01", None, None, "n", 1, "10", 0.0, "other"),
        ("V007", 1004, None, "shipped", "2000-01-01", None, None, "n", 1, "10", 0.0, "N/A"),
        ("V008", 1004, None, "open", "2000-02-10", "2000-02-05", "2000-02-01", "x", 0, "-5", 1.5, "gadget"),
        ("X009", 1001, None, "lost", "2000-02-10", None, None, "y", 1, "10", 0.0, "software"),
    ], "po_number string, cust_no int, sales_rep int, order_status string, order_date string, ship_date string, "
       "date_needed string, paid string, qty_ordered int, total_value string, discount double, item_type string")
    return t


def test_load_types_defaults_and_computed(db):
    e = db["employee"]
    assert dict(e.dtypes)["salary"] == "decimal(10,2)" and dict(e.dtypes)["hire_date"] == "timestamp_ntz"
    r = e.where(C("emp_no") == 3).first()
    assert r["full_name"] == "O'Neil, Cy" and r["hire_date"] == AS_OF and r["phone_ext"] is None
    d = db["department"].where(C("dept_no") == "000").first()
    assert d["phone_no"] == "555-1234"
    s = db["sales"].where(C("po_number") == "V001").first()
    assert s["aged"] == 4.0


def test_phone_list(db):
    view = company.phone_list(db["employee"], db["department"])
    out = [tuple(r) for r in reports.phone_list(view, "Harbor", ["last_name", "first_name", "phone_ext"],
                                                ["last_name", "first_name"]).collect()]
    assert out == [("O'Neil", "Cy", None), ("Okafor", "Ann", "101"), ("Okafor", "Bo", "102"),
                   ("van Dam", "Di", "104")]


def test_org_chart(db):
    units = db["department"].select(C("dept_no").alias("node"), C("head_dept").alias("parent"),
                                    C("department").alias("name"))
    managers = db["department"].select("dept_no", "mngr_no")
    staff = db["employee"].select("emp_no", "dept_no", "full_name", "job_code")
    out = [tuple(r) for r in reports.org_chart(units, managers, staff).collect()]
    assert out == [("000", None, "Corporate", "Okafor, Ann", "Mgr", 1),
                   ("100", "Corporate", "Sales", "Okafor, Bo", "Mgr", 2),
                   ("110", "Sales", "Field Sales", "--TBH--", "", 1),
                   ("111", "Field Sales", "Field East", "--TBH--", "", 1),
                   ("200", "Corporate", "Lab", "O'Neil, Cy", "Eng", 1),
                   ("300", "Corporate", "Empty Unit", "--TBH--", "", 0)]


def test_budget_rollup_and_sub_totals(db):
    dep = db["department"]
    out = {r["dept_no"]: (r["subtree_total"], r["has_null"])
           for r in hierarchy.tree_rollup(dep, "dept_no", "head_dept", "budget").collect()}
    assert out == {"000": (2550000.0, True), "100": (750000.0, False), "110": (250000.0, False),
                   "111": (50000.0, False), "200": (800000.0, False), "300": (0.0, True)}
    sub = {r["head_dept"]: tuple(r)[1:] for r in aggregates.sub_totals(
        dep.where(C("head_dept").isNotNull()), "head_dept", "budget").collect()}
    assert sub["000"] == (1300000.0, 650000.0, 500000.0, 800000.0, 2)
    assert sub["110"] == (50000.0, 50000.0, 50000.0, 50000.0, 1)


def test_mail_labels(db):
    out = {r["cust_no"]: tuple(r)[1:] for r in reports.mail_labels(db["customer"], "cust_no").collect()}
    assert out[1001] == ("Acme", "Ann Lee", "1 Main", "", "Reno, NV  89501", "")
    assert out[1002] == ("Bolt", "Kim", "2 Side", "Suite 4", "CA  90001", "")
    assert out[1003] == ("Cog", None, "3 Rue", "", None, "Freedonia    F-1")
    assert out[1004] == ("Dyn", "Cy Ng", "", "", "Oslo, Ost", None)


def test_ship_decisions(db):
    s = db["sales"].select(C("po_number").alias("o_orderkey"), C("cust_no").alias("o_custkey"),
                           "order_status", "ship_date", "paid")
    c = db["customer"].select(C("cust_no").alias("c_custkey"), "on_hold")
    out = dict((r[0], r[2]) for r in reports.ship_decisions(s, c, AS_OF).collect())
    assert out == {"V001": "already_shipped", "V002": "ship", "V003": "already_shipped", "V004": "on_hold",
                   "V005": "already_shipped", "V006": "overdue", "V007": "already_shipped", "V008": "ship",
                   "X009": "ship"}


def test_all_langs_listing(db):
    j = db["job"]
    out = reports.slots_with_separators(
        j, "job_code", C("job_code"), C("job_grade").cast("string"), C("job_country"), "language_req").collect()
    assert len(out) == 5 * 6
    eng = sorted((r["seq"], r["value"]) for r in out if r["job_code"] == "Eng")
    assert eng == [(1, "English"), (2, "NULL"), (3, "NULL"), (4, "NULL"), (5, "NULL"), (6, "==============")]
    mgr = [r["value"] for r in out if r["job_code"] == "Mgr" and r["seq"] <= 5]
    assert mgr == [None] * 5


def test_employee_projects_and_add(db, spark):
    keys = spark.createDataFrame([(1,), (3,)], "emp_no int")
    out = sorted(tuple(r) for r in reports.assignments(db["employee_project"], "emp_no", keys, "emp_no",
                                                       ["emp_no", "proj_id"]).collect())
    assert out == [(1, "ALPHA"), (3, "beta")]
    new = spark.createDataFrame([(4, "ALPHA"), (1, "ALPHA"), (8, "ALPHA"), (3, "ZETA")], "emp_no int, proj_id string")
    acc, rej = changes.insert_checked(new, {"employee": ("emp_no", db["employee"], "emp_no"),
                                            "project": ("proj_id", db["project"], "proj_id")},
                                      existing=db["employee_project"], key=["emp_no", "proj_id"])
    assert [tuple(r) for r in acc.collect()] == [(4, "ALPHA")]
    assert sorted(tuple(r) for r in rej.collect()) == [(1, "ALPHA", "duplicate_key"), (3, "ZETA", "unknown_project"),
                                                       (8, "ALPHA", "unknown_employee")]


def test_delete_employee(db, spark):
    """Employee 2 still has sales and is refused; employee 3 goes, and with it
    their project links, their manager mark and their team-leader mark."""
    keys = spark.createDataFrame([(2,), (3,)], "emp_no int")
    new_emp, kids, refused, accepted = changes.cascade_delete(
        db["employee"], "emp_no", keys, "emp_no", db["sales"], "sales_rep",
        {"employee_project": (db["employee_project"], "emp_no", "delete"),
         "department": (db["department"], "mngr_no", "nullify"),
         "project": (db["project"], "team_leader", "nullify")})
    assert [tuple(r) for r in refused.collect()] == [(2, "has_blocking_rows")]
    assert [r[0] for r in accepted.collect()] == [3]
    assert sorted(r[0] for r in new_emp.select("emp_no").collect()) == [1, 2, 4, 5, 6]
    assert sorted(tuple(r) for r in kids["employee_project"].collect()) == [(1, "ALPHA"), (2, "ALPHA"), (5, "GAMMA"),
                                                                           (9, "ALPHA")]
    assert [(r["dept_no"], r["mngr_no"]) for r in kids["department"].where(C("cleared")).collect()] == [("200", None)]
    assert [(r["proj_id"], r["team_leader"]) for r in kids["project"].where(C("cleared")).collect()] == \
        [("beta", None)]
    # no reference left to the removed employee
    assert rules.orphans(kids["employee_project"], ["emp_no"], new_emp, ["emp_no"]) \
        .where(C("emp_no") != 9).count() == 0


def test_salary_audit(db):
    old = db["employee"]
    new = changes.update_where(old, "salary", C("dept_no") == "100",
                               (C("salary") * F.lit("1.1").cast("decimal(2,1)")).cast("decimal(10,2)"))
    out = sorted((r["emp_no"], r["old_value"], r["new_value"], r["percent_change"])
                 for r in audit.audit_changes(old, new, ["emp_no"], "salary", AS_OF, "admin").collect())
    assert [o[:3] for o in out] == [(2, 80000.0, 88000.0), (4, 25000.0, 27500.0)]
    assert all(abs(o[3] - 10.0) < 1e-9 for o in out)


def test_constraint_report(db):
    rep = {(r["table_name"], r["kind"], r["constraint_name"]): r["n_violations"]
           for r in company.constraint_report(db).collect()}
    expected = {
        ("job", "check", "min_salary < max_salary"): 2,
        ("job", "check", "job_code:jobcode"): 1,
        ("job", "check", "job_grade:jobgrade"): 1,
        ("job", "foreign_key", "job_country -> country"): 1,
        ("employee", "salary_range", "salary within job range"): 2,
        ("employee", "foreign_key", "job_code,job_grade,job_country -> job"): 1,
        ("employee", "primary_key", "emp_no"): 0,
        ("employee_project", "foreign_key", "emp_no -> employee"): 1,
        ("project", "check", "proj_id:projno"): 1,
        ("project", "check", "product:prodtype"): 1,
        ("customer", "check", "cust_no:custno"): 1,
        ("sales", "check", "po_number:ponumber"): 1,
        ("sales", "check", "order_status:order_status"): 1,
        ("sales", "check", "paid:paid"): 1,
        ("sales", "check", "qty_ordered:qty_ordered"): 1,
        ("sales", "check", "total_value:total_value"): 1,
        ("sales", "check", "discount:discount"): 1,
        ("sales", "check", "item_type:prodtype"): 1,
        ("sales", "check", "ship_date >= order_date"): 1,
        ("sales", "check", "date_needed > order_date"): 1,
        ("sales", "check", "shipped has ship_date"): 1,
        ("sales", "on_hold", "shipped to a customer on hold"): 1,
        ("department", "unique", "department"): 0,
        ("department", "foreign_key", "head_dept -> department"): 0,
        ("department", "check", "dept_no:deptno"): 0,
    }
    assert {k: rep.get(k) for k in expected} == expected
    assert rep[("employee", "not_null", "first_name")] == 0
