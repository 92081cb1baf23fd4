"""B1-B6 reports on small hand-made tables."""

import datetime as dt

from pyspark.sql import functions as F

from rowsmith.plans import reports

from helpers import rows

C = F.col

CONTACT_SCHEMA = ("k int, customer string, contact_first string, contact_last string, address_line1 string, "
                  "address_line2 string, city string, state_province string, country string, postal_code string")


def test_mail_labels_null_rules(spark):
    data = [
        (1, "Acme", "Ann", "Lee", "1 Main", None, "Reno", "NV", "USA", "89501"),      # USA with city
        (2, "Bolt", None, "Kim", "2 Side", "Suite 4", None, "CA", "USA", "90001"),    # USA no city, no first
        (3, "Cog", "Bo", None, "3 Rue", None, "Lyon", None, "France", "69000"),       # abroad, no state, no last
        (4, "Dyn", "Cy", "Ng", None, None, "Oslo", "Ost", "Norway", None),            # no postal code
        (5, None, None, None, None, None, None, None, None, None),                    # all missing
    ]
    df = spark.createDataFrame(data, CONTACT_SCHEMA)
    out = {r["k"]: tuple(r)[1:] for r in reports.mail_labels(df, "k").collect()}
    assert out[1] == ("Acme", "Ann Lee", "1 Main", "", "Reno, NV  89501", "")
    assert out[2] == ("Bolt", "Kim", "2 Side", "Suite 4", "CA  90001", "")
    assert out[3] == ("Cog", None, "3 Rue", "", None, "France    69000")
    assert out[4] == ("Dyn", "Cy Ng", "", "", "Oslo, Ost", None)
    assert out[5] == ("", None, "", "", None, None)


def test_org_chart(spark):
    units = spark.createDataFrame([(0, None, "Corp"), (1, 0, "Sales"), (2, 0, "Lab"), (3, 1, "East")],
                                  "node long, parent long, name string")
    managers = spark.createDataFrame([(0, 10), (1, None), (2, 12), (3, None)], "dept_no long, mngr_no long")
    staff = spark.createDataFrame([(10, 0, "Boss, Ann", "CEO"), (11, 1, "Rep, Bo", "SRep"), (12, 2, "Sci, Cy", "Eng"),
                                   (13, 1, "Rep, Di", "SRep")],
                                  "emp_no long, dept_no long, full_name string, job_code string")
    out = [tuple(r) for r in reports.org_chart(units, managers, staff).collect()]
    assert out == [(0, None, "Corp", "Boss, Ann", "CEO", 1), (1, "Corp", "Sales", "--TBH--", "", 2),
                   (2, "Corp", "Lab", "Sci, Cy", "Eng", 1), (3, "Sales", "East", "--TBH--", "", 0)]


def test_ship_decision_order_of_tests(spark):
    as_of = dt.datetime(2000, 3, 1)
    d = lambda days: as_of - dt.timedelta(days=days)
    sales = spark.createDataFrame([
        (1, 100, "shipped", d(10), "y"),    # already shipped, even though customer is on hold
        (2, 100, "open", None, "n"),        # on hold
        (3, 200, "shipped", d(61), "n"),    # shipped unpaid 61 days ago: customer 200 overdue
        (4, 200, "open", None, "n"),        # -> overdue
        (5, 300, "shipped", d(60), "n"),    # exactly 60 days: not overdue
        (6, 300, "waiting", None, "y"),     # -> ship
        (7, 400, "open", None, "y"),        # customer unknown -> ship
    ], "o_orderkey long, o_custkey long, order_status string, ship_date timestamp_ntz, paid string")
    cust = spark.createDataFrame([(100, "*"), (200, None), (300, None)], "c_custkey long, on_hold string")
    out = dict(rows(reports.ship_decisions(sales, cust, as_of), "o_orderkey", "decision"))
    assert out == {1: "already_shipped", 2: "on_hold", 3: "already_shipped", 4: "overdue", 5: "already_shipped",
                   6: "ship", 7: "ship"}


def test_slots_with_separators(spark):
    df = spark.createDataFrame([(1, "Eng", "Utopia", ["en", " "]), (2, "Mgr", "Utopia", None)],
                               "k long, t string, c string, langs array<string>")
    out = sorted(tuple(r) for r in reports.slots_with_separators(df, "k", C("k").cast("string"), C("t"), C("c"),
                                                                  "langs").collect())
    assert len(out) == 12
    assert out[:6] == [(1, 1, "1", "Eng", "Utopia", "en"), (1, 2, "1", "Eng", "Utopia", "NULL"),
                       (1, 3, "1", "Eng", "Utopia", None), (1, 4, "1", "Eng", "Utopia", None),
                       (1, 5, "1", "Eng", "Utopia", None),
                       (1, 6, "=====", "=====", "===============", "==============")]


def test_phone_list_and_assignments(spark):
    view = spark.createDataFrame([("Okafor", "K", 1, "Harbor"), ("Alvarez", "O", 2, "Harbor"),
                                  ("Okafor", "B", 3, "Harbor"), ("Lindqvist", "X", 4, "Uplands")],
                                 "last string, first string, id int, location string")
    out = [tuple(r) for r in reports.phone_list(view, "Harbor", ["last", "first"], ["last", "first"]).collect()]
    assert out == [("Alvarez", "O"), ("Okafor", "B"), ("Okafor", "K")]
    link = spark.createDataFrame([(1, "A"), (1, "A"), (1, "B"), (2, "C")], "emp int, proj string")
    keys = spark.createDataFrame([(1,), (9,)], "e int")
    assert rows(reports.assignments(link, "emp", keys, "e", ["emp", "proj"])) == [(1, "A"), (1, "B")]


def test_org_chart_dangling_manager_gives_null(spark):
    """A manager id with no employee row leaves name and title NULL
    (only a unit without any manager gets the fallback)."""
    units = spark.createDataFrame([(0, None, "Corp")], "node long, parent long, name string")
    managers = spark.createDataFrame([(0, 99)], "dept_no long, mngr_no long")
    staff = spark.createDataFrame([(10, 0, "Boss, Ann", "CEO")],
                                  "emp_no long, dept_no long, full_name string, job_code string")
    assert [tuple(r) for r in reports.org_chart(units, managers, staff).collect()] == \
        [(0, None, "Corp", None, None, 1)]
