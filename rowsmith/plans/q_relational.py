"""Catalogued queries: sources, filters, joins, aggregates, sort, scalar and
array functions (S1-S5, F1-F9, J1-J7, A1-A4, O1, X1-X10, R1-R2)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsmith.functions import arrays, dates, scalars
from rowsmith.operators import aggregates, hierarchy, joins, positions, predicates
from rowsmith.plans import standins as si
from rowsmith.plans.registry import query, with_ctes
from rowsmith.session import scratch_path
from rowsmith.sources import quarantine, report_text, tables
from rowsmith.sources.tables import Catalog

# ============================================================================ S


@query("scan_table", "S1", """
SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00'""")
def scan_table(spark, base):
    """Four columns of the largest table, for one range of dates: column list
    and filter reach the file scan."""
    return (tables.scan(spark, base, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_shipdate"])
            .where(F.col("l_shipdate") >= dates.ntz_literal("1998-01-01 00:00:00")))


LOAD_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("o_orderkey", T.LongType()), ("o_custkey", T.LongType()), ("o_orderstatus", T.StringType()),
    ("o_totalprice", T.DoubleType()), ("o_orderdate", T.TimestampNTZType()), ("o_orderpriority", T.StringType()),
    ("paid", T.StringType()), ("qty_ordered", T.IntegerType()), ("discount", T.DoubleType()),
    ("item_type", T.StringType()), ("sales_rep", T.StringType()))])
LOAD_DEFAULTS = {"paid": "n", "qty_ordered": 1, "discount": 0.0, "item_type": "software"}


@query("load_with_defaults", "S2", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
       nullif(o_orderpriority, '5-LOW') AS o_orderpriority,
       'n' AS paid, CAST(1 AS INTEGER) AS qty_ordered, CAST(0.0 AS DOUBLE) AS discount,
       'software' AS item_type, CAST(NULL AS VARCHAR) AS sales_rep
FROM orders""")
def load_with_defaults(spark, base):
    """Orders, their dates written as MM/DD/YY text, loaded into a wider sales
    schema: the dates are read with the year pivot, the absent columns take
    their DEFAULT (or NULL), the explicit NULL priorities stay NULL."""
    incoming = (tables.scan(spark, base, "orders")
                .withColumn("o_orderpriority", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")))
                .withColumn("o_orderdate", dates.format_mdy("o_orderdate")))
    return tables.load_with_defaults(incoming, LOAD_SCHEMA, LOAD_DEFAULTS, mdy_pivot=50)


@query("load_quarantine", "S2", """
WITH lines AS (SELECT o_orderkey,
    CASE o_orderpriority WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%m/%d/%y') END AS o_orderdate,
    CASE o_orderstatus WHEN 'P' THEN 'n/a' ELSE '12' END AS qty_ordered FROM orders),
bad AS (SELECT *, o_orderdate LIKE '____/%' AS bad_date, qty_ordered = 'n/a' AS bad_qty FROM lines),
counts AS (SELECT count(*) FILTER (NOT bad_date AND NOT bad_qty) AS n_loaded, count(*) FILTER (bad_date OR bad_qty) AS n_refused FROM bad)
SELECT part, o_orderkey, column_name, value, n_loaded::BIGINT AS n_loaded, n_refused::BIGINT AS n_refused FROM (
  SELECT 'loaded' AS part, o_orderkey, 'o_orderdate' AS column_name, strftime(strptime(o_orderdate, '%m/%d/%y'), '%Y-%m-%d') AS value
    FROM bad WHERE NOT bad_date AND NOT bad_qty
  UNION ALL SELECT 'refused', o_orderkey, 'o_orderdate', o_orderdate FROM bad WHERE bad_date
  UNION ALL SELECT 'refused', o_orderkey, 'qty_ordered', qty_ordered FROM bad WHERE bad_qty) t, counts""")
def load_quarantine(spark, base):
    """Orders as text lines, some with dates in another form and some without
    a quantity, loaded in one pass: the rows that fit, the refused ones with
    each value that could not be read, and the counts of both."""
    o = tables.scan(spark, base, "orders", ["o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus"])
    other_form = F.date_format("o_orderdate", "yyyy/MM/dd")
    lines = o.select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") == "3-MEDIUM", other_form).otherwise(dates.format_mdy("o_orderdate")).alias("o_orderdate"),
        F.when(F.col("o_orderstatus") == "P", "n/a").otherwise("12").alias("qty_ordered"))
    schema = T.StructType([LOAD_SCHEMA["o_orderkey"], LOAD_SCHEMA["o_orderdate"], LOAD_SCHEMA["paid"], LOAD_SCHEMA["qty_ordered"]])
    load = quarantine.load_apart(lines, schema, scratch_path(spark, "load"), LOAD_DEFAULTS, mdy_pivot=50)
    counts = [F.lit(load.n_loaded).cast("long").alias("n_loaded"), F.lit(load.n_refused).cast("long").alias("n_refused")]
    good = load.loaded.select(F.lit("loaded").alias("part"), "o_orderkey", F.lit("o_orderdate").alias("column_name"),
                              F.date_format("o_orderdate", "yyyy-MM-dd").alias("value"), *counts)
    bad = load.refused.select(F.lit("refused").alias("part"), F.col("o_orderkey").cast("long").alias("o_orderkey"),
                              F.inline("problems"), *counts)
    return good.unionByName(bad)


def order_contacts(cat: Catalog):
    return contacts_of(cat.orders, cat.customer)


def contacts_of(o, c):
    return (joins.join_inner(o, c, "o_custkey", "c_custkey")
                 .select("o_orderkey", "c_name", "o_orderpriority", "o_orderstatus",
                         F.col("c_mktsegment").alias("location"), "c_nationkey"))


ORDER_CONTACTS_SQL = """order_contacts AS (
  SELECT o_orderkey, c_name, o_orderpriority, o_orderstatus, c_mktsegment AS location, c_nationkey
  FROM orders, customer WHERE o_custkey = c_custkey)"""


@query("view_phone_list", "S3", with_ctes(ORDER_CONTACTS_SQL, body="SELECT * FROM order_contacts"))
def view_phone_list(spark, base):
    tables.register_view(order_contacts(Catalog(spark, base)), "order_contacts")
    return spark.sql("SELECT * FROM order_contacts")


@query("row_position", "S4", """
SELECT c_custkey, c_name, c_mktsegment,
       row_number() OVER (ORDER BY c_mktsegment, c_name, c_custkey) - 1 AS position
FROM customer""")
def row_position(spark, base):
    c = tables.scan(spark, base, "customer", ["c_custkey", "c_name", "c_mktsegment"])
    return positions.with_position(c, ["c_mktsegment", "c_name", "c_custkey"])


REPORT_COLS, REPORT_WIDTHS, REPORT_HEAD = ["c_name", "c_mktsegment", "c_nationkey"], [20, 15, None], \
    ["NAME", "SEGMENT", "NATION"]


def _pad_sql(expr: str, w: int) -> str:
    return f"(CASE WHEN length({expr}) >= {w} THEN {expr} ELSE rpad({expr}, {w}, ' ') END)"


@query("fixed_width_report", "S5", f"""
SELECT CAST(0 AS BIGINT) AS line_no,
       {_pad_sql("'NAME'", 20)} || ' ' || {_pad_sql("'SEGMENT'", 15)} || ' ' || 'NATION' AS line
UNION ALL
SELECT row_number() OVER (ORDER BY c_name, c_custkey) AS line_no,
       {_pad_sql("coalesce(c_name, '')", 20)} || ' ' || {_pad_sql("coalesce(c_mktsegment, '')", 15)}
       || ' ' || coalesce(CAST(c_nationkey AS VARCHAR), '') AS line
FROM customer""")
def fixed_width_report(spark, base):
    """The customer listing as fixed-width text lines, heading first, data
    lines numbered in name order."""
    c = tables.scan(spark, base, "customer")
    return report_text.fixed_width_report(c, REPORT_COLS, REPORT_WIDTHS, REPORT_HEAD, order_by=["c_name", "c_custkey"])


@query("report_file", "S5", f"""
SELECT CAST(0 AS BIGINT) AS line_no,
       {_pad_sql("'NAME'", 20)} || ' ' || {_pad_sql("'SEGMENT'", 15)} || ' ' || 'NATION' AS line
UNION ALL
SELECT row_number() OVER (ORDER BY c_name, c_custkey) AS line_no,
       {_pad_sql("coalesce(c_name, '')", 20)} || ' ' || {_pad_sql("coalesce(c_mktsegment, '')", 15)}
       || ' ' || coalesce(CAST(c_nationkey AS VARCHAR), '') AS line
FROM customer""")
def report_file(spark, base):
    """The customer listing written as text files and read back: the lines by
    their place in the files, which is the report's order."""
    c = tables.scan(spark, base, "customer")
    lines = report_text.fixed_width_report(c, REPORT_COLS, REPORT_WIDTHS, REPORT_HEAD, order_by=["c_name", "c_custkey"])
    path = scratch_path(spark, "report_file")
    report_text.write_text_report(lines, path, in_order=True)
    return report_text.read_text_report(spark, path)


# ============================================================================ F


@query("project_columns", "F1", "SELECT c_name, c_custkey, c_mktsegment FROM customer")
def project_columns(spark, base):
    return predicates.project(tables.scan(spark, base, "customer"), ["c_name", "c_custkey", "c_mktsegment"])


@query("filter_param", "F2",
       "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_param(spark, base):
    c = tables.scan(spark, base, "customer")
    return predicates.filter_eq(c, "c_mktsegment", "BUILDING").select("c_custkey", "c_name", "c_acctbal")


@query("filter_range", "F3", """
SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'""")
def filter_range(spark, base):
    o = tables.scan(spark, base, "orders")
    lo, hi = F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1997-01-01").cast("timestamp_ntz")
    return predicates.filter_range(o, "o_orderdate", lo, hi).select("o_orderkey", "o_orderdate")


@query("filter_between", "F4", """
SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.04""")
def filter_between(spark, base):
    li = tables.scan(spark, base, "lineitem")
    return predicates.filter_between(li, "l_discount", 0.02, 0.04).select("l_orderkey", "l_linenumber", "l_discount")


@query("filter_in_list", "F5", """
SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P')""")
def filter_in_list(spark, base):
    o = tables.scan(spark, base, "orders")
    o = predicates.filter_in_list(o, "o_orderpriority", ["1-URGENT", "2-HIGH"])
    o = predicates.filter_in_list(o, "o_orderstatus", ["P"], negate=True)
    return o.select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query("filter_null_logic", "F6", """
SELECT o_orderkey, prio, prio IS NULL AS prio_missing
FROM (SELECT o_orderkey, o_orderstatus, nullif(o_orderpriority, '5-LOW') AS prio FROM orders) t
WHERE o_orderstatus = 'O' AND (prio IS NULL OR prio NOT IN ('1-URGENT', '2-HIGH'))""")
def filter_null_logic(spark, base):
    o = tables.scan(spark, base, "orders").select(
        "o_orderkey", "o_orderstatus", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("prio"))
    # NOT IN alone drops the NULL rows (unknown); IS NULL brings them back
    pred = (F.col("o_orderstatus") == "O") & (F.col("prio").isNull()
                                              | predicates.not_in_list("prio", ["1-URGENT", "2-HIGH"]))
    return predicates.filter_where(o, pred).select("o_orderkey", "prio",
                                                   F.col("prio").isNull().alias("prio_missing"))


@query("filter_prefix", "F7", "SELECT p_partkey, p_brand FROM part WHERE starts_with(p_brand, 'Brand#1')")
def filter_prefix(spark, base):
    return predicates.filter_prefix(tables.scan(spark, base, "part"), "p_brand", "Brand#1") \
                     .select("p_partkey", "p_brand")


@query("filter_boolean", "F8", """
SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem
WHERE (l_returnflag = 'R' AND l_quantity > 40) OR NOT (l_linestatus = 'O' OR l_discount < 0.09)""")
def filter_boolean(spark, base):
    li = tables.scan(spark, base, "lineitem")
    c = F.col
    pred = ((c("l_returnflag") == "R") & (c("l_quantity") > 40)) | \
        ~((c("l_linestatus") == "O") | (c("l_discount") < 0.09))
    return predicates.filter_where(li, pred).select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")


@query("scalar_subquery", "F9", with_ctes(si.ORDERS_KEYED_SQL, si.RANGES_SQL, body="""
SELECT o.o_orderkey,
       CAST((SELECT r.min_price FROM ranges r WHERE r.o_orderstatus = o.o_orderstatus
              AND r.o_orderpriority = o.o_orderpriority AND r.o_year = o.o_year) AS DOUBLE) AS min_price,
       CAST((SELECT r.max_price FROM ranges r WHERE r.o_orderstatus = o.o_orderstatus
              AND r.o_orderpriority = o.o_orderpriority AND r.o_year = o.o_year) AS DOUBLE) AS max_price
FROM okeyed o"""))
def scalar_subquery(spark, base):
    """Each order's allowed price range by its (status, priority, year) key, as a
    correlated scalar look-up (NULL where the key has no range row)."""
    cat = Catalog(spark, base)
    out = predicates.scalar_lookup(si.orders_keyed(cat), si.range_table(cat),
                                   ["o_orderstatus", "o_orderpriority", "o_year"], ["min_price", "max_price"], known_unique=True)
    return out.select("o_orderkey", F.col("min_price").cast("double").alias("min_price"),
                      F.col("max_price").cast("double").alias("max_price"))


# ============================================================================ J


@query("join_inner", "J1", """
SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders, customer WHERE o_custkey = c_custkey""")
def join_inner(spark, base):
    cat = Catalog(spark, base)
    return joins.join_inner(cat.orders, cat.customer, "o_custkey", "c_custkey") \
                .select("o_orderkey", "o_custkey", "c_name", "c_mktsegment")


@query("join_left_self", "J2", with_ctes(si.PART_TREE_SQL, body="""
SELECT d.node, d.name, h.name AS parent_name
FROM ptree d LEFT OUTER JOIN ptree h ON d.parent = h.node"""))
def join_left_self(spark, base):
    """Each part with its parent's name (NULL for the root). The nullable
    parent id is left out of the result: the name carries it, and a
    nullable bigint converts differently to pandas in Spark and DuckDB."""
    t = si.part_tree(Catalog(spark, base))
    return joins.join_parent(t, "node", "parent", ["name"]).select("node", "name", "parent_name")


MANAGERS_SQL = f"""managers AS (
  SELECT c.c_custkey AS dept_no,
         CASE WHEN c.c_mktsegment <> '{si.UNMANAGED_SEGMENT}' THEN m.first_order END AS mngr_no
  FROM customer c LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey) m
    ON m.o_custkey = c.c_custkey),
staff AS (
  SELECT o_orderkey AS emp_no, o_custkey AS dept_no, o_orderstatus || ', ' || o_orderpriority AS full_name,
         o_orderpriority AS job_code
  FROM orders)"""


def managers(cat: Catalog):
    """Department -> manager link: the first order of each customer, none
    for one market segment (stand-in)."""
    o, c = cat.orders, cat.customer
    first = o.groupBy(F.col("o_custkey").alias("__ck")).agg(F.min("o_orderkey").alias("first_order"))
    return (c.join(first, c["c_custkey"] == first["__ck"], "left")
             .select(F.col("c_custkey").alias("dept_no"),
                     F.when(F.col("c_mktsegment") != si.UNMANAGED_SEGMENT, F.col("first_order")).alias("mngr_no")))


def staff(cat: Catalog):
    """Employees: one per order, in the department of its customer (stand-in)."""
    return cat.orders.select(F.col("o_orderkey").alias("emp_no"), F.col("o_custkey").alias("dept_no"),
                             scalars.concat_null(F.col("o_orderstatus"), ", ", F.col("o_orderpriority"))
                             .alias("full_name"),
                             F.col("o_orderpriority").alias("job_code"))


@query("join_lookup_default", "J3", with_ctes(MANAGERS_SQL, body="""
SELECT m.dept_no,
       CASE WHEN m.mngr_no IS NULL THEN '--TBH--' ELSE s.full_name END AS mngr_name,
       CASE WHEN m.mngr_no IS NULL THEN '' ELSE s.job_code END AS title
FROM managers m LEFT JOIN staff s ON s.emp_no = m.mngr_no"""))
def join_lookup_default(spark, base):
    """Each unit's manager name and job, or the fallback when it has no
    manager; a manager id with no employee row gives NULL."""
    cat = Catalog(spark, base)
    return joins.join_lookup_default(managers(cat), staff(cat), "mngr_no", "emp_no",
                                     {"mngr_name": ("full_name", "--TBH--"), "title": ("job_code", "")}) \
                .select("dept_no", "mngr_name", "title")


@query("join_composite", "J4", with_ctes(si.ORDERS_KEYED_SQL, si.RANGES_SQL, body="""
SELECT o.o_orderkey, o.o_year, CAST(r.min_price AS DOUBLE) AS min_price, CAST(r.max_price AS DOUBLE) AS max_price
FROM okeyed o JOIN ranges r
  ON r.o_orderstatus = o.o_orderstatus AND r.o_orderpriority = o.o_orderpriority AND r.o_year = o.o_year"""))
def join_composite(spark, base):
    """Orders joined to their price range on the three-part key."""
    cat = Catalog(spark, base)
    out = joins.join_composite(si.orders_keyed(cat), si.range_table(cat),
                               ["o_orderstatus", "o_orderpriority", "o_year"])
    return out.select("o_orderkey", "o_year", F.col("min_price").cast("double").alias("min_price"),
                      F.col("max_price").cast("double").alias("max_price"))


@query("join_semi", "J5", with_ctes(si.SALES_SQL, si.CUST_SQL, body="""
SELECT s.o_orderkey, s.order_status FROM sales s
WHERE NOT (s.order_status = 'shipped'
           AND EXISTS (SELECT 1 FROM cust c WHERE c.c_custkey = s.o_custkey AND c.on_hold = '*'))"""))
def join_semi(spark, base):
    """Orders passing ``NOT (shipped AND EXISTS (customer on hold))``: an
    anti join whose condition also holds the status test."""
    cat = Catalog(spark, base)
    s = si.sales(cat)
    held = si.held_customers(cat).where(F.col("on_hold") == "*").select("c_custkey")
    on = (s["o_custkey"] == held["c_custkey"]) & (s["order_status"] == "shipped")
    return joins.join_semi(s, held, on, negate=True).select("o_orderkey", "order_status")


@query("join_anti", "J6", """
SELECT d.doc_id, d.source FROM documents d
WHERE d.doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def join_anti(spark, base):
    cat = Catalog(spark, base)
    return joins.join_anti(cat.documents.select("doc_id", "source"), cat.labels, "doc_id", "doc_id")


@query("join_lateral", "J7", with_ctes(si.PART_WORD_LIST_SQL, body="""
SELECT p_partkey, CAST(generate_subscripts(words, 1) AS INTEGER) AS slot, unnest(words) AS value
FROM pwords WHERE words IS NOT NULL"""))
def join_lateral(spark, base):
    """Every word of every part name with its place."""
    w = si.part_word_list(Catalog(spark, base))
    return joins.join_lateral_explode(w, "words", keep_empty=False).select("p_partkey", "slot", "value")


# ============================================================================ A


@query("agg_sub_totals", "A1", with_ctes(si.CUST_TREE_SQL, body="""
SELECT parent,
       CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total,
       CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / nullif(count(value), 0) AS average,
       CAST(min(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS smallest,
       CAST(max(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS largest,
       count(value) AS n_values
FROM ctree WHERE parent IS NOT NULL GROUP BY parent"""))
def agg_sub_totals(spark, base):
    """Total, average, smallest and largest balance of the children of every
    parent in the customer tree (all parents at once)."""
    t = si.customer_tree(Catalog(spark, base)).where(F.col("parent").isNotNull())
    return aggregates.sub_totals(t, "parent", "value")


@query("agg_filtered_count", "A2", """
SELECT o_orderstatus,
       count(CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN nullif(o_orderpriority, '5-LOW') END) AS n
FROM orders GROUP BY o_orderstatus""")
def agg_filtered_count(spark, base):
    o = tables.scan(spark, base, "orders")
    return aggregates.filtered_count(o, ["o_orderstatus"], F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")),
                                     F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))


@query("agg_count_with_zero", "A3", """
SELECT s.source, CAST(coalesce(n.n, 0) AS BIGINT) AS n_toxic
FROM (SELECT DISTINCT source FROM documents) s
LEFT JOIN (SELECT d.source, count(*) AS n FROM labels l JOIN documents d ON d.doc_id = l.doc_id
           WHERE l.toxic = 1 GROUP BY d.source) n ON n.source = s.source""")
def agg_count_with_zero(spark, base):
    """Toxic labels per document source; sources without any show 0."""
    cat = Catalog(spark, base)
    docs = cat.documents.select("doc_id", "source")
    toxic = cat.labels.where(F.col("toxic") == 1).join(docs, "doc_id").select("source")
    return aggregates.count_with_zero(docs.select("source").distinct(), "source", toxic, "source", "n_toxic")


@query("agg_tree_rollup", "A4", "WITH RECURSIVE " + si.PART_TREE_SQL + """,
closure(anc, node) AS (
  SELECT node, node FROM ptree
  UNION ALL
  SELECT c.anc, t.node FROM closure c JOIN ptree t ON t.parent = c.node)
SELECT a.node, CAST(CAST(a.value AS DECIMAL(12,2)) AS DOUBLE) AS own_value,
       CAST(sum(coalesce(CAST(d.value AS DECIMAL(12,2)), 0)) AS DOUBLE) AS subtree_total,
       count(d.value) AS subtree_values, count(*) AS subtree_nodes,
       bool_or(d.value IS NULL) AS has_null
FROM closure c JOIN ptree a ON a.node = c.anc JOIN ptree d ON d.node = c.node
GROUP BY a.node, a.value""")
def agg_tree_rollup(spark, base):
    """Every part's own value plus the values of all parts below it in the
    part tree."""
    return hierarchy.tree_rollup(si.part_tree(Catalog(spark, base)), "node", "parent", "value")


# ============================================================================ O


@query("sort_multi_key", "O1", """
SELECT s_suppkey, s_name, s_nationkey, s_acctbal,
       row_number() OVER (ORDER BY s_nationkey ASC NULLS FIRST, s_acctbal DESC NULLS LAST, s_suppkey ASC) - 1
         AS position
FROM supplier""")
def sort_multi_key(spark, base):
    """Multi-key sort, NULL order stated; the rank in the sorted result is
    returned as ``position`` so the order itself is part of the result."""
    s = tables.scan(spark, base, "supplier")
    order = [F.col("s_nationkey").asc_nulls_first(), F.col("s_acctbal").desc_nulls_last(),
             F.col("s_suppkey").asc()]
    return positions.with_position(s, order)


# ============================================================================ X


@query("fn_concat_null", "X1", """
SELECT c_custkey, c_name || ' / ' || nullif(c_mktsegment, 'HOUSEHOLD') AS label FROM customer""")
def fn_concat_null(spark, base):
    c = tables.scan(spark, base, "customer")
    return c.select("c_custkey", scalars.concat_null(F.col("c_name"), " / ",
                                                     F.nullif(F.col("c_mktsegment"), F.lit("HOUSEHOLD")))
                    .alias("label"))


@query("fn_upper", "X2", """
SELECT p_partkey, p_name = upper(p_name) AS name_is_upper, p_type = upper(p_type) AS type_is_upper FROM part""")
def fn_upper(spark, base):
    p = tables.scan(spark, base, "part")
    return p.select("p_partkey", scalars.is_upper("p_name").alias("name_is_upper"),
                    scalars.is_upper("p_type").alias("type_is_upper"))


@query("fn_parse_date", "X3", """
SELECT o_orderkey, txt AS order_date_text,
       CAST(make_date(CASE WHEN yy >= 50 THEN 1900 + yy ELSE 2000 + yy END, mm, dd) AS TIMESTAMP) AS parsed_date,
       CAST(make_date(CASE WHEN yy >= 50 THEN 1900 + yy ELSE 2000 + yy END, mm, dd) AS TIMESTAMP) = o_orderdate
         AS round_trip
FROM (SELECT o_orderkey, o_orderdate, strftime(o_orderdate, '%m/%d/%y') AS txt,
             CAST(split_part(strftime(o_orderdate, '%m/%d/%y'), '/', 1) AS INTEGER) AS mm,
             CAST(split_part(strftime(o_orderdate, '%m/%d/%y'), '/', 2) AS INTEGER) AS dd,
             CAST(split_part(strftime(o_orderdate, '%m/%d/%y'), '/', 3) AS INTEGER) AS yy
      FROM orders) t""")
def fn_parse_date(spark, base):
    """Order dates written as MM/dd/yy text and read back with the year pivot;
    ``round_trip`` says the parsed date equals the original."""
    o = tables.scan(spark, base, "orders").select("o_orderkey", "o_orderdate",
                                                  dates.format_mdy("o_orderdate").alias("order_date_text"))
    parsed = dates.parse_mdy("order_date_text", pivot=50)
    return o.select("o_orderkey", "order_date_text", parsed.alias("parsed_date"),
                    (parsed == F.col("o_orderdate")).alias("round_trip"))


@query("fn_days_between", "X4", """
SELECT l_orderkey, l_linenumber,
       CAST(epoch_us(l_shipdate) - epoch_us(o_orderdate) AS DOUBLE) / 1000000.0 / 86400.0 AS days
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def fn_days_between(spark, base):
    cat = Catalog(spark, base)
    li, o = cat.lineitem, cat.orders
    j = joins.join_inner(li, o, "l_orderkey", "o_orderkey")
    return j.select("l_orderkey", "l_linenumber", dates.days_between("o_orderdate", "l_shipdate").alias("days"))


@query("fn_minus_days", "X5", """
SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem
WHERE l_shipdate < TIMESTAMP '1996-03-01' - INTERVAL 60 DAY""")
def fn_minus_days(spark, base):
    li = tables.scan(spark, base, "lineitem")
    return li.where(F.col("l_shipdate") < dates.minus_days("1996-03-01 00:00:00", 60)) \
             .select("l_orderkey", "l_linenumber", "l_shipdate")


@query("fn_case_chain", "X6", """
SELECT o_orderkey,
       CASE WHEN o_orderstatus = 'F' THEN 'done'
            WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'rush'
            WHEN o_totalprice > 300000 THEN 'large'
            ELSE 'normal' END AS category
FROM orders""")
def fn_case_chain(spark, base):
    o = tables.scan(spark, base, "orders")
    cat = scalars.case_chain([(F.col("o_orderstatus") == "F", "done"),
                              (F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "rush"),
                              (F.col("o_totalprice") > 300000, "large")], "normal")
    return o.select("o_orderkey", cat.alias("category"))


@query("fn_decimal_math", "X7", with_ctes(si.ORDERS_KEYED_SQL, body="""
SELECT o_orderkey, CAST(price AS DOUBLE) AS price, CAST(raised AS DOUBLE) AS raised,
       (CAST(raised AS DOUBLE) - CAST(price AS DOUBLE)) * CAST(100.0 AS DOUBLE)
         / nullif(CAST(price AS DOUBLE), 0) AS pct_change
FROM (SELECT o_orderkey, price,
             CAST(round(price * CAST('1.075' AS DECIMAL(9,4)), 2) AS DECIMAL(12,2)) AS raised
      FROM okeyed) t"""))
def fn_decimal_math(spark, base):
    """Prices raised by 7.5% in exact decimals (rounded half up), and the
    percent change between old and new."""
    o = si.orders_keyed(Catalog(spark, base))
    raised = scalars.raise_by_percent("price", "7.5")
    o = o.select("o_orderkey", "price", raised.alias("raised"))
    return o.select("o_orderkey", F.col("price").cast("double").alias("price"),
                    F.col("raised").cast("double").alias("raised"),
                    scalars.percent_change("price", "raised").alias("pct_change"))


@query("fn_int_add", "X8", """
SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BIGINT) + CAST(CAST(l_quantity AS INTEGER) AS BIGINT) AS k
FROM lineitem""")
def fn_int_add(spark, base):
    li = tables.scan(spark, base, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     scalars.int_add("l_linenumber", F.col("l_quantity").cast("int")).alias("k"))


@query("fn_int_sub", "X9", """
SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INTEGER) AS BIGINT) - CAST(l_linenumber AS BIGINT) AS d
FROM lineitem""")
def fn_int_sub(spark, base):
    li = tables.scan(spark, base, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     scalars.int_sub(F.col("l_quantity").cast("int"), "l_linenumber").alias("d"))


@query("fn_int_double", "X10", "SELECT p_partkey, CAST(p_size AS BIGINT) * 2 AS size2 FROM part")
def fn_int_double(spark, base):
    p = tables.scan(spark, base, "part")
    return p.select("p_partkey", scalars.int_double("p_size").alias("size2"))


# ============================================================================ R


@query("array_element", "R1", """
SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first_value, CAST(embedding[64] AS DOUBLE) AS value_64,
       CAST(embedding[65] AS DOUBLE) AS value_65
FROM embeddings""")
def array_element(spark, base):
    """1-based subscripts of each embedding: the first, the last, and one past
    the end (NULL)."""
    e = tables.scan(spark, base, "embeddings")
    return e.select("vec_id", arrays.element("embedding", 1).cast("double").alias("first_value"),
                    arrays.element("embedding", 64).cast("double").alias("value_64"),
                    arrays.element("embedding", 65).cast("double").alias("value_65"))


@query("array_slots", "R2", with_ctes(si.PART_WORDS_SQL, body="""
SELECT p_partkey, CAST(s.slot AS INTEGER) AS slot,
       CASE WHEN trim(words[s.slot]) = '' THEN 'NULL' ELSE words[s.slot] END AS value
FROM pwords, (SELECT unnest(range(1, 6)) AS slot) s"""))
def array_slots(spark, base):
    """The five name-word slots of every part as rows."""
    w = si.part_words(Catalog(spark, base)).select("p_partkey", "words")
    return arrays.array_slots(w, "words", 5)
