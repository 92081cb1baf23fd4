"""Catalogued queries: reports and text search."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowsmith.functions import text
from rowsmith.plans import reports
from rowsmith.plans import standins as si
from rowsmith.plans.q_relational import MANAGERS_SQL, ORDER_CONTACTS_SQL, contacts_of, managers, order_contacts, staff
from rowsmith.plans.registry import query, with_ctes
from rowsmith.session import scratch_path, scratch_table
from rowsmith.sources import tables
from rowsmith.sources.tables import Catalog

C = F.col

# Buckets of the catalogued bucketed tables; at scale one for some hundred MB of the larger table.
BUCKETS = 8

# ============================================================================ B


@query("report_phone_list", "B1", with_ctes(ORDER_CONTACTS_SQL, body="""
SELECT c_name, o_orderpriority, o_orderkey FROM order_contacts WHERE location = 'BUILDING'
ORDER BY c_name, o_orderpriority, o_orderkey"""))
def report_phone_list(spark, base):
    """Flagship: the contact view of one location, sorted."""
    view = order_contacts(Catalog(spark, base))
    return reports.phone_list(view, "BUILDING", ["c_name", "o_orderpriority", "o_orderkey"],
                              ["c_name", "o_orderpriority", "o_orderkey"])


@query("phone_list_bucketed", "B1", with_ctes(ORDER_CONTACTS_SQL, body="""
SELECT c_name, o_orderpriority, o_orderkey FROM order_contacts WHERE location = 'BUILDING'
ORDER BY c_name, o_orderpriority, o_orderkey"""))
def phone_list_bucketed(spark, base):
    """The same report over orders and customers written once as tables
    bucketed on the customer key: bucket meets bucket, and nothing is shuffled
    before the sort."""
    cat, root = Catalog(spark, base), scratch_path(spark, "bucketed")
    orders = tables.write_bucketed(cat.orders, f"{root}/orders", scratch_table(spark, "orders"), BUCKETS, "o_custkey")
    customer = tables.write_bucketed(cat.customer, f"{root}/customer", scratch_table(spark, "customer"), BUCKETS, "c_custkey")
    view = contacts_of(orders, customer.hint("merge"))
    return reports.phone_list(view, "BUILDING", ["c_name", "o_orderpriority", "o_orderkey"],
                              ["c_name", "o_orderpriority", "o_orderkey"])


@query("report_org_chart", "B2", with_ctes(si.CUST_TREE_SQL, MANAGERS_SQL, body=f"""
SELECT d.node AS dept_no, h.name AS head_dept, d.name AS department,
       CASE WHEN m.mngr_no IS NULL THEN '{reports.NO_MANAGER}' ELSE s.full_name END AS mngr_name,
       CASE WHEN m.mngr_no IS NULL THEN '' ELSE s.job_code END AS title,
       (SELECT count(*) FROM staff e WHERE e.dept_no = d.node) AS emp_cnt
FROM ctree d
LEFT OUTER JOIN ctree h ON d.parent = h.node
LEFT JOIN managers m ON m.dept_no = d.node
LEFT JOIN staff s ON s.emp_no = m.mngr_no
ORDER BY d.node"""))
def report_org_chart(spark, base):
    """One row per unit of the customer tree: parent name, unit, manager or
    the fallback, title, head count."""
    cat = Catalog(spark, base)
    units = si.customer_tree(cat).select("node", "parent", "name")
    return reports.org_chart(units, managers(cat), staff(cat))


def mail_contacts(cat: Catalog):
    """Contacts with gaps, from customer x nation x region (stand-in)."""
    c, n, r = cat.customer, cat.nation, cat.region
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, C("n_regionkey") == r["r_regionkey"])
    return j.select(
        "c_custkey",
        C("c_name").alias("customer"),
        F.when(C("c_mktsegment") != "BUILDING", F.split_part(C("c_name"), F.lit("#"), F.lit(1)))
         .alias("contact_first"),
        F.when(C("c_mktsegment") != "MACHINERY", F.split_part(C("c_name"), F.lit("#"), F.lit(2)))
         .alias("contact_last"),
        C("n_name").alias("address_line1"),
        F.when(C("c_acctbal") > 5000, F.concat(F.lit("Suite "), C("c_nationkey").cast("string")))
         .alias("address_line2"),
        F.when(C("c_mktsegment") != "HOUSEHOLD", C("n_name")).alias("city"),
        F.when(C("r_name") != "EUROPE", C("r_name")).alias("state_province"),
        F.when(C("r_name") == "AMERICA", F.lit("USA")).when(C("r_name") == "AFRICA", F.lit(None))
         .otherwise(C("n_name")).alias("country"),
        F.when(C("c_mktsegment") != "FURNITURE", F.lpad(C("c_custkey").cast("string"), 5, "0"))
         .alias("postal_code"))


MAIL_CONTACTS_SQL = """contacts AS (
  SELECT c_custkey, c_name AS customer,
         CASE WHEN c_mktsegment <> 'BUILDING' THEN split_part(c_name, '#', 1) END AS contact_first,
         CASE WHEN c_mktsegment <> 'MACHINERY' THEN split_part(c_name, '#', 2) END AS contact_last,
         n_name AS address_line1,
         CASE WHEN c_acctbal > 5000 THEN 'Suite ' || CAST(c_nationkey AS VARCHAR) END AS address_line2,
         CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN n_name END AS city,
         CASE WHEN r_name <> 'EUROPE' THEN r_name END AS state_province,
         CASE WHEN r_name = 'AMERICA' THEN 'USA' WHEN r_name = 'AFRICA' THEN NULL ELSE n_name END AS country,
         CASE WHEN c_mktsegment <> 'FURNITURE' THEN lpad(CAST(c_custkey AS VARCHAR), 5, '0') END AS postal_code
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query("report_mail_labels", "B3", with_ctes(MAIL_CONTACTS_SQL, body="""
SELECT c_custkey,
       coalesce(customer, '') AS line1,
       CASE WHEN contact_first IS NOT NULL THEN contact_first || ' ' || contact_last ELSE contact_last END AS line2,
       coalesce(address_line1, '') AS line3,
       coalesce(address_line2, '') AS line4,
       CASE WHEN coalesce(country = 'USA', false) THEN
              CASE WHEN city IS NOT NULL THEN city || ', ' || state_province || '  ' || postal_code
                   ELSE state_province || '  ' || postal_code END
            ELSE CASE WHEN city IS NOT NULL THEN city || ', ' || state_province ELSE state_province END
       END AS line5,
       CASE WHEN coalesce(country = 'USA', false) THEN '' ELSE country || '    ' || postal_code END AS line6
FROM contacts"""))
def report_mail_labels(spark, base):
    """The six mailing-label lines of every customer."""
    return reports.mail_labels(mail_contacts(Catalog(spark, base)), "c_custkey")


@query("report_ship_decision", "B4", with_ctes(si.SALES_SQL, si.CUST_SQL, body=f"""
SELECT s.o_orderkey, s.o_custkey,
       CASE WHEN s.order_status = 'shipped' THEN '{reports.ALREADY_SHIPPED}'
            WHEN c.on_hold = '*' THEN '{reports.ON_HOLD}'
            WHEN EXISTS (SELECT 1 FROM sales x WHERE x.o_custkey = s.o_custkey AND x.order_status = 'shipped'
                         AND x.paid = 'n' AND x.ship_date < {si.AS_OF_SQL} - INTERVAL 60 DAY)
              THEN '{reports.OVERDUE}'
            ELSE '{reports.SHIP}' END AS decision
FROM sales s LEFT JOIN cust c ON c.c_custkey = s.o_custkey"""))
def report_ship_decision(spark, base):
    """The ship decision for every order, as of the fixed date."""
    cat = Catalog(spark, base)
    return reports.ship_decisions(si.sales(cat), si.held_customers(cat).select("c_custkey", "on_hold"), si.AS_OF)


@query("ship_orders", "B4", with_ctes(si.SALES_SQL, si.CUST_SQL, body=f"""
, judged AS (
  SELECT s.*, s.order_status <> 'shipped' AND NOT coalesce(c.on_hold = '*', false)
         AND NOT EXISTS (SELECT 1 FROM sales x WHERE x.o_custkey = s.o_custkey AND x.order_status = 'shipped'
                         AND x.paid = 'n' AND x.ship_date < {si.AS_OF_SQL} - INTERVAL 60 DAY) AS ships
  FROM sales s LEFT JOIN cust c ON c.c_custkey = s.o_custkey)
SELECT o_orderkey, o_custkey, CASE WHEN ships THEN 'shipped' ELSE order_status END AS order_status,
       CASE WHEN ships THEN {si.AS_OF_SQL} ELSE ship_date END AS ship_date, paid
FROM judged""").replace(")\n\n, judged", "),\njudged"))
def ship_orders(spark, base):
    """The sales after every order that may be shipped has been."""
    cat = Catalog(spark, base)
    out = reports.shipped_sales(si.sales(cat), si.held_customers(cat).select("c_custkey", "on_hold"), si.AS_OF)
    return out.select("o_orderkey", "o_custkey", "order_status", "ship_date", "paid")


@query("report_slots_with_separators", "B5", with_ctes(si.PART_WORDS_SQL, body=f"""
SELECT p_partkey AS group_key, CAST(s.seq AS INTEGER) AS seq, CAST(p_partkey AS VARCHAR) AS code, p_type AS grade,
       p_brand AS country, CASE WHEN trim(words[s.seq]) = '' THEN 'NULL' ELSE words[s.seq] END AS value
FROM pwords, (SELECT unnest(range(1, 6)) AS seq) s
UNION ALL
SELECT p_partkey, 6, '{reports.SEPARATOR_CODE}', '{reports.SEPARATOR_GRADE}', '{reports.SEPARATOR_COUNTRY}',
       '{reports.SEPARATOR_VALUE}'
FROM pwords"""))
def report_slots_with_separators(spark, base):
    """The five name-word slots of every part with a separator row after each."""
    w = si.part_words(Catalog(spark, base))
    return reports.slots_with_separators(w, "p_partkey", C("p_partkey").cast("string"), C("p_type"), C("p_brand"),
                                         "words") \
                  .withColumnRenamed("p_partkey", "group_key")


@query("report_assignments", "B6", """
SELECT DISTINCT l_suppkey, l_partkey FROM lineitem
WHERE l_suppkey IN (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
                    JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')""")
def report_assignments(spark, base):
    """The parts each supplier of one region has shipped (link-table look-up
    for a key set)."""
    cat = Catalog(spark, base)
    s, n, r = cat.supplier, cat.nation, cat.region
    keys = (s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, C("n_regionkey") == r["r_regionkey"])
             .where(C("r_name") == "EUROPE").select("s_suppkey"))
    return reports.assignments(cat.lineitem, "l_suppkey", keys, "s_suppkey", ["l_suppkey", "l_partkey"])


# ============================================================================ T

NEEDLE = "th"


@query("text_find_spans", "T1", f"""
WITH s AS (SELECT doc_id, string_split(text, '{NEEDLE}') AS parts FROM documents WHERE contains(text, '{NEEDLE}')),
p AS (SELECT doc_id, len(parts) AS n, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM s)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS match_no,
       CAST(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            + (i - 1) * {len(NEEDLE)} AS BIGINT) AS start,
       CAST(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            + (i - 1) * {len(NEEDLE)} + {len(NEEDLE)} AS BIGINT) AS "end"
FROM p WHERE i < n""")
def text_find_spans(spark, base):
    """Every match of the needle in every document, as character spans."""
    docs = tables.scan(spark, base, "documents", ["doc_id", "text"])
    return text.find_spans(docs, "doc_id", "text", NEEDLE)


@query("text_highlight", "T2", f"""
SELECT doc_id, replace(text, '{NEEDLE}', '{text.MARK_OPEN}{NEEDLE}{text.MARK_CLOSE}') AS marked FROM documents""")
def text_highlight(spark, base):
    """Every document with each match wrapped in the marks."""
    docs = tables.scan(spark, base, "documents", ["doc_id", "text"])
    return docs.select("doc_id", text.highlight("text", NEEDLE).alias("marked"))


@query("text_clear_marks", "T3", f"""
SELECT doc_id, cleared, cleared = text AS round_trip
FROM (SELECT doc_id, text,
             replace(replace(replace(text, '{NEEDLE}', '{text.MARK_OPEN}{NEEDLE}{text.MARK_CLOSE}'),
                             '{text.MARK_OPEN}', ''), '{text.MARK_CLOSE}', '') AS cleared
      FROM documents) t""")
def text_clear_marks(spark, base):
    """Marks put on every match, then cleared: the plain text comes back."""
    docs = tables.scan(spark, base, "documents", ["doc_id", "text"])
    cleared = text.clear_marks(text.highlight("text", NEEDLE))
    return docs.select("doc_id", cleared.alias("cleared"), (cleared == C("text")).alias("round_trip"))
