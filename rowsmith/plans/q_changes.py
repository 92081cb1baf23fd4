"""Catalogued queries: table changes, integrity checks, audit and the stream
(M1-M7, C1-C10, D1-D2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowsmith.operators import audit, changes, constraints as cs, rules
from rowsmith.operators.aggregates import MONEY, MONEY_SUM
from rowsmith.operators.generator import KeyGenerator
from rowsmith.operators.rules import Rule
from rowsmith.plans import standins as si
from rowsmith.plans.registry import query, with_ctes
from rowsmith.session import scratch_path, stored
from rowsmith.sources import tables
from rowsmith.sources.tables import Catalog
from rowsmith.streaming import new_rows
from rowsmith.streaming.audit_stream import audit_files

C = F.col

# ============================================================================ M


@query("update_where", "M1", """
SELECT c_custkey, c_name, c_acctbal,
       CASE WHEN c_acctbal < 0 THEN 'ON HOLD' ELSE c_mktsegment END AS c_mktsegment
FROM customer""")
def update_where(spark, base):
    """Customers with a negative balance have their segment set to ON HOLD."""
    c = tables.scan(spark, base, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return changes.update_where(c, "c_mktsegment", C("c_acctbal") < 0, "ON HOLD")


@query("update_sequence", "M2", with_ctes(si.ORDERS_KEYED_SQL, si.PRICE_UPDATES_SQL, body="""
SELECT o_orderkey, CAST(price AS DOUBLE) AS price FROM s4"""))
def update_sequence(spark, base):
    """The four ordered price updates over all orders; later steps read the
    prices earlier steps wrote."""
    o = si.orders_keyed(Catalog(spark, base))
    new = changes.update_sequence(o, si.price_update_steps())
    return new.select("o_orderkey", C("price").cast("double").alias("price"))


@query("update_by_mapping", "M3", """
SELECT c.c_custkey, c.c_name,
       CASE WHEN m.c IS NOT NULL THEN m.open_value ELSE c.c_acctbal END AS c_acctbal
FROM customer c
LEFT JOIN (SELECT o_custkey AS c, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS open_value
           FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) m ON m.c = c.c_custkey""")
def update_by_mapping(spark, base):
    """SET balance = value of open orders, by customer key, for the customers
    that have any (the mapping is a table of key -> value pairs derived from
    orders)."""
    cat = Catalog(spark, base)
    mapping = (cat.orders.where(C("o_orderstatus") == "O")
                  .groupBy("o_custkey")
                  .agg(F.sum(C("o_totalprice").cast(MONEY)).cast(MONEY_SUM).cast("double").alias("open_value")))
    c = cat.customer.select("c_custkey", "c_name", "c_acctbal")
    return changes.update_by_mapping(c, "c_custkey", mapping, "o_custkey", {"c_acctbal": "open_value"})


@query("null_out_references", "M4", f"""
SELECT o_orderkey,
       CAST(CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = '{si.LOST_PARENT_SEGMENT}')
                 THEN NULL ELSE o_custkey END AS VARCHAR) AS o_custkey
FROM orders""")
def null_out_references(spark, base):
    """Orders whose customer was removed lose the reference. The NULL-able
    key is handed out as text: Spark and DuckDB convert a nullable bigint to
    different pandas types (float64 / Int64), text converts the same."""
    cat = Catalog(spark, base)
    removed = cat.customer.where(C("c_mktsegment") == si.LOST_PARENT_SEGMENT).select("c_custkey")
    out = changes.null_out_references(cat.orders.select("o_orderkey", "o_custkey"), "o_custkey",
                                      removed, "c_custkey")
    return out.select("o_orderkey", C("o_custkey").cast("string").alias("o_custkey"))


@query("cascade_delete", "M5", """
WITH wanted AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal < 0),
blocked AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'),
accepted AS (SELECT k FROM wanted WHERE k NOT IN (SELECT k FROM blocked))
SELECT 'customer' AS table_name, k AS key, 'refused' AS action FROM wanted WHERE k IN (SELECT k FROM blocked)
UNION ALL
SELECT 'customer', c_custkey, 'deleted' FROM customer WHERE c_custkey IN (SELECT k FROM accepted)
UNION ALL
SELECT 'orders', o_orderkey, 'reference_cleared' FROM orders WHERE o_custkey IN (SELECT k FROM accepted)""")
def cascade_delete(spark, base):
    """Delete the customers with a negative balance, unless they have an
    open order; their other orders keep the row with the reference cleared.
    Result: the change log (table_name, key, action)."""
    cat = Catalog(spark, base)
    cust, orders = cat.customer, cat.orders
    wanted = cust.where(C("c_acctbal") < 0).select("c_custkey")
    blockers = orders.where(C("o_orderstatus") == "O").select("o_custkey")
    _, kids, refused, accepted = changes.cascade_delete(
        cust, "c_custkey", wanted, "c_custkey", blockers, "o_custkey",
        {"orders": (orders.select("o_orderkey", "o_custkey"), "o_custkey", "nullify")})
    deleted = cust.select("c_custkey").join(accepted, "c_custkey", "left_semi").select(
        F.lit("customer").alias("table_name"), C("c_custkey").alias("key"), F.lit("deleted").alias("action"))
    cleared = (kids["orders"].where(C("cleared"))
               .select(F.lit("orders").alias("table_name"), C("o_orderkey").alias("key"),
                       F.lit("reference_cleared").alias("action")))
    ref = refused.select(F.lit("customer").alias("table_name"), C("c_custkey").alias("key"),
                         F.lit("refused").alias("action"))
    return ref.unionByName(deleted).unionByName(cleared)


@query("insert_checked", "M6", """
WITH parents AS (SELECT doc_id FROM documents WHERE lang <> 'es'),
existing AS (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 1),
incoming AS (SELECT doc_id, quality, toxic FROM labels UNION ALL SELECT doc_id, 1 - quality, toxic FROM labels WHERE quality = 0),
tested AS (SELECT *, doc_id IN (SELECT doc_id FROM parents) AS known FROM incoming)
SELECT doc_id, quality, toxic,
       CASE WHEN NOT known THEN 'unknown_document'
            WHEN doc_id IN (SELECT doc_id FROM existing)
                 OR row_number() OVER (PARTITION BY doc_id, known ORDER BY quality, toxic) > 1 THEN 'duplicate_key'
            ELSE 'accepted' END AS status
FROM tested""")
def insert_checked(spark, base):
    """Insert all labels, those of bad quality a second time as good ones,
    into a label table that already holds the toxic good-quality ones, whose
    parent table has lost the Spanish documents: each row comes out accepted
    or with its reason."""
    cat = Catalog(spark, base)
    new = cat.labels.unionByName(cat.labels.where(C("quality") == 0).withColumn("quality", F.lit(1)))
    parents = cat.documents.where(C("lang") != "es").select("doc_id")
    existing = cat.labels.where((C("quality") == 1) & (C("toxic") == 1))
    return changes.insert_tagged(new, {"document": ("doc_id", parents, "doc_id")}, existing=existing, key=["doc_id"])


@query("guarded_delete", "M5", f"""
WITH accepted AS (SELECT c_custkey AS k FROM customer WHERE c_mktsegment = '{si.LOST_PARENT_SEGMENT}'
                  AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')),
gone AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT k FROM accepted))
SELECT 'orders' AS table_name, o_orderkey AS key, 'deleted' AS action FROM gone
UNION ALL
SELECT 'customer', node, 'reference_cleared' FROM ctree WHERE parent IN (SELECT k FROM accepted)
UNION ALL
SELECT 'customer', k, 'deleted' FROM accepted""".replace("WITH accepted", "WITH " + si.CUST_TREE_SQL + ",\naccepted"))
def guarded_delete(spark, base):
    """Delete the customers of one segment that have no order in progress:
    their orders go with them, customers below them in the tree stay with the
    reference cleared. Result: the change log."""
    cat = Catalog(spark, base)
    cust, orders = cat.customer, cat.orders
    wanted = cust.where(C("c_mktsegment") == si.LOST_PARENT_SEGMENT).select("c_custkey")
    busy = orders.where(C("o_orderstatus") == "P").select("o_custkey")
    tree = si.customer_tree(cat).select("node", "parent")
    _, kids, _, accepted = changes.cascade_delete(
        cust, "c_custkey", wanted, "c_custkey", busy, "o_custkey",
        {"orders": (orders.select("o_orderkey", "o_custkey"), "o_custkey", "delete"), "tree": (tree, "parent", "nullify")})
    left = kids["orders"].select(C("o_orderkey").alias("__left"))
    gone = orders.select("o_orderkey").join(left, C("o_orderkey") == C("__left"), "left_anti")

    def logged(df, table, key, action):
        return df.select(F.lit(table).alias("table_name"), C(key).alias("key"), F.lit(action).alias("action"))
    return (logged(gone, "orders", "o_orderkey", "deleted")
            .unionByName(logged(kids["tree"].where("cleared"), "customer", "node", "reference_cleared"))
            .unionByName(logged(accepted, "customer", "c_custkey", "deleted")))


@query("assign_keys", "M7", """
WITH inc AS (SELECT CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_custkey END AS c_custkey, c_name FROM customer)
SELECT c_custkey, c_name FROM inc WHERE c_custkey IS NOT NULL
UNION ALL
SELECT CAST((SELECT coalesce(max(c_custkey), 0) FROM inc) + row_number() OVER (ORDER BY c_name) AS BIGINT), c_name
FROM inc WHERE c_custkey IS NULL""")
def assign_keys(spark, base):
    """Customers of one segment arrive without a key; they get keys after
    the high-water mark, in name order."""
    c = tables.scan(spark, base, "customer")
    incoming = c.select(F.when(C("c_mktsegment") != "FURNITURE", C("c_custkey")).alias("c_custkey"), "c_name")
    return changes.assign_keys(incoming, "c_custkey", ["c_name"])


@query("assign_keys_again", "M7", """
WITH marks AS (SELECT max(c_custkey) FILTER (c_mktsegment <> 'FURNITURE') AS mark, count(*) FILTER (c_mktsegment = 'FURNITURE') AS n FROM customer),
first AS (SELECT c_custkey, c_name FROM customer WHERE c_mktsegment <> 'FURNITURE' UNION ALL
    SELECT mark + row_number() OVER (ORDER BY c_name), c_name FROM customer, marks WHERE c_mktsegment = 'FURNITURE'),
kept AS (SELECT * FROM first WHERE c_custkey < (SELECT max(c_custkey) FROM first))
SELECT 1 AS load, CAST(c_custkey AS BIGINT) AS c_custkey, c_name FROM kept UNION ALL
SELECT 2, CAST(greatest(mark + n, mark) + row_number() OVER (ORDER BY s_name) AS BIGINT), s_name FROM supplier, marks""")
def assign_keys_again(spark, base):
    """Two loads from one key generator: customers of one segment get keys,
    the customer with the highest key is deleted, and suppliers that become
    customers get keys after the mark, not the deleted one."""
    c = tables.scan(spark, base, "customer")
    incoming = c.select(F.when(C("c_mktsegment") != "FURNITURE", C("c_custkey")).alias("c_custkey"), "c_name")
    keys = KeyGenerator(spark, scratch_path(spark, "generator"))
    first = stored(changes.assign_keys(incoming, "c_custkey", ["c_name"], generator=keys, run="first"), "customers")
    kept = first.where(C("c_custkey") < F.lit(first.agg(F.max("c_custkey")).first()[0]))
    new = tables.scan(spark, base, "supplier").select(F.lit(None).cast("long").alias("c_custkey"), C("s_name").alias("c_name"))
    second = changes.assign_keys(new, "c_custkey", ["c_name"], generator=keys, run="second")
    return kept.select(F.lit(1).alias("load"), "*").unionByName(second.select(F.lit(2).alias("load"), "*"))


# ============================================================================ C

LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def lineitem_with_gaps(cat: Catalog):
    """lineitem with NULLs where a value is 'missing' (stand-in)."""
    return cat.lineitem.select(*[c for c in LINEITEM_COLS if c not in ("l_returnflag", "l_tax")],
                               F.nullif(C("l_returnflag"), F.lit("R")).alias("l_returnflag"),
                               F.nullif(C("l_tax"), F.lit(0.0)).alias("l_tax"))


LI_GAPS_SQL = """li AS (
  SELECT * REPLACE (nullif(l_returnflag, 'R') AS l_returnflag, nullif(l_tax, 0.0) AS l_tax) FROM lineitem)"""


@query("check_not_null", "C1", with_ctes(LI_GAPS_SQL, body="\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM li" for c in LINEITEM_COLS)))
def check_not_null(spark, base):
    """NULL count of every lineitem column, in one pass."""
    return rules.null_counts(lineitem_with_gaps(Catalog(spark, base)), LINEITEM_COLS)


@query("check_primary_key", "C2", """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def check_primary_key(spark, base):
    """(order, line number) values held by more than one lineitem row."""
    return rules.duplicate_keys(tables.scan(spark, base, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("check_unique", "C3", """
SELECT p_name, p_size, count(*) AS n_rows
FROM (SELECT nullif(p_name, 'red widget') AS p_name, p_size FROM part) t
WHERE p_name IS NOT NULL AND p_size IS NOT NULL
GROUP BY p_name, p_size HAVING count(*) > 1""")
def check_unique(spark, base):
    """UNIQUE (name, size): a NULL part never collides."""
    p = tables.scan(spark, base, "part").select(F.nullif(C("p_name"), F.lit("red widget")).alias("p_name"),
                                                "p_size")
    return rules.duplicate_keys(p, ["p_name", "p_size"], null_is_distinct=True)


@query("check_foreign_key", "C4", f"""
SELECT o_orderkey, o_custkey
FROM (SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey END AS o_custkey FROM orders) o
WHERE o_custkey IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey
                  AND c.c_mktsegment <> '{si.LOST_PARENT_SEGMENT}')""")
def check_foreign_key(spark, base):
    """orders.o_custkey -> customer, against a customer table that lost one
    segment; a NULL reference (here: low priority orders) is allowed."""
    cat = Catalog(spark, base)
    child = cat.orders.select("o_orderkey", F.when(C("o_orderpriority") != "5-LOW", C("o_custkey"))
                              .alias("o_custkey"))
    parent = cat.customer.where(C("c_mktsegment") != si.LOST_PARENT_SEGMENT)
    return rules.orphans(child, ["o_custkey"], parent, ["c_custkey"]).select("o_orderkey", "o_custkey")


@query("check_foreign_key_composite", "C5", with_ctes(si.ORDERS_KEYED_SQL, si.RANGES_SQL, body="""
SELECT o_orderkey, o_orderstatus, o_orderpriority, o_year FROM okeyed o
WHERE NOT EXISTS (SELECT 1 FROM ranges r WHERE r.o_orderstatus = o.o_orderstatus
                  AND r.o_orderpriority = o.o_orderpriority AND r.o_year = o.o_year)"""))
def check_foreign_key_composite(spark, base):
    """Orders whose (status, priority, year) key has no price-range row."""
    cat = Catalog(spark, base)
    keys = ["o_orderstatus", "o_orderpriority", "o_year"]
    return rules.orphans(si.orders_keyed(cat), keys, si.range_table(cat), keys) \
                .select("o_orderkey", *keys)


@query("check_self_reference", "C6", with_ctes(si.PART_TREE_SQL, body="""
, kept AS (SELECT * FROM ptree WHERE ptype <> 'PROMO')
SELECT node, 'missing_parent' AS status FROM kept k
WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM kept p WHERE p.node = k.parent)
UNION ALL
SELECT node, 'root' AS status FROM kept WHERE parent IS NULL""").replace(")\n\n, kept", "),\nkept"))
def check_self_reference(spark, base):
    """The part tree after its PROMO parts were dropped: children of a
    dropped part have a missing parent."""
    t = si.part_tree(Catalog(spark, base)).where(C("ptype") != "PROMO")
    return rules.self_reference(t, "node", "parent").select("node", "status")


def _domain_checks(cat: Catalog):
    """(table, rules) pairs: test columns checked against the schema's domains
    and column rules, one aggregation pass per table."""
    from rowsmith.operators.domains import column_rule as col_r, domain_rule as dom_r
    from rowsmith.functions.scalars import percent_change
    li = lineitem_with_gaps(cat).select(
        "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_returnflag",
        C("l_extendedprice").cast(MONEY).alias("l_extendedprice"), F.year("l_shipdate").alias("ship_year"),
        percent_change(C("l_extendedprice"), C("l_extendedprice") * (F.lit(1.0) - C("l_discount")))
        .alias("price_change_pct"))
    li_rules = [dom_r("l_linenumber", "jobgrade"), dom_r("l_partkey", "custno"),
                dom_r("l_extendedprice", "budget"), dom_r("l_returnflag", "deptno"),
                col_r("l_quantity", "qty_ordered"), col_r("l_discount", "discount"),
                col_r("l_tax", "discount"), col_r("ship_year", "fiscal_year"),
                col_r("price_change_pct", "percent_change")]
    part = cat.part.select("p_name", "p_brand", "p_type", C("p_retailprice").cast(MONEY).alias("p_retailprice"))
    part_rules = [dom_r("p_name", "projno"), dom_r("p_brand", "jobcode"), dom_r("p_type", "prodtype"),
                  dom_r("p_retailprice", "salary"), dom_r("p_brand", "ponumber")]
    sales = si.sales(cat).select("order_status", "paid", "total_value")
    sales_rules = [col_r("order_status", "order_status"), col_r("paid", "paid"),
                   col_r("total_value", "total_value")]
    cust = si.held_customers(cat).select("on_hold")
    return [(li, li_rules), (part, part_rules), (sales, sales_rules), (cust, [col_r("on_hold", "on_hold")])]


# The CHECK rules as the schema declares them. The length of a
# VARCHAR(n) is the type's, not a CHECK: it says nothing of NULL.
_DOMAIN_CHECKS_SQL = [
    ("li", [
        ("jobgrade(l_linenumber)", "l_linenumber BETWEEN 0 AND 6"),
        ("custno(l_partkey)", "l_partkey > 1000"),
        ("budget(l_extendedprice)", "CAST(l_extendedprice AS DECIMAL(12,2)) > 10000 "
                                    "AND CAST(l_extendedprice AS DECIMAL(12,2)) <= 2000000"),
        ("deptno(l_returnflag)", "(l_returnflag = '000' OR (l_returnflag > '0' AND l_returnflag <= '999') "
                                 "OR l_returnflag IS NULL) AND coalesce(length(l_returnflag), 0) <= 3"),
        ("qty_ordered(l_quantity)", "l_quantity >= 1"),
        ("discount(l_discount)", "l_discount >= 0 AND l_discount <= 1"),
        ("discount(l_tax)", "l_tax >= 0 AND l_tax <= 1"),
        ("fiscal_year(ship_year)", "year(l_shipdate) >= 1993"),
        ("percent_change(price_change_pct)",
         "(l_extendedprice * (CAST(1.0 AS DOUBLE) - l_discount) - l_extendedprice) * CAST(100.0 AS DOUBLE)"
         " / nullif(l_extendedprice, 0) BETWEEN -50 AND 50"),
    ]),
    ("part", [
        ("projno(p_name)", "length(p_name) <= 5 AND p_name = upper(p_name)"),
        ("jobcode(p_brand)", "length(p_brand) <= 5 AND p_brand > '99999'"),
        ("prodtype(p_type)", "length(p_type) <= 12 AND p_type IN ('software', 'hardware', 'other', 'N/A') "
                             "AND p_type IS NOT NULL"),
        ("salary(p_retailprice)", "CAST(p_retailprice AS DECIMAL(12,2)) > 0"),
        ("ponumber(p_brand)", "length(p_brand) <= 8 AND starts_with(p_brand, 'V')"),
    ]),
    ("sales", [
        ("order_status(order_status)", "order_status IN ('new', 'open', 'shipped', 'waiting')"),
        ("paid(paid)", "paid IN ('y', 'n')"),
        ("total_value(total_value)", "total_value >= 0"),
    ]),
    ("cust", [("on_hold(on_hold)", "on_hold IS NULL OR on_hold = '*'")]),
]


def _rule_sql(name, pred, table):
    return (f"SELECT '{name}' AS rule, count(*) FILTER (WHERE NOT coalesce(({pred}), true)) AS n_violations, "
            f"count(*) FILTER (WHERE ({pred}) IS NULL) AS n_unknown FROM {table}")


@query("check_domains", "C7", with_ctes(
    LI_GAPS_SQL, si.SALES_SQL, si.CUST_SQL,
    body="\nUNION ALL\n".join(_rule_sql(n, p, t) for t, rs in _DOMAIN_CHECKS_SQL for n, p in rs)))
def check_domains(spark, base):
    """Columns checked against the schema's named domains (type length and
    CHECK) and named column rules: one aggregation pass per table, one count
    row per rule."""
    out = None
    for df, rs in _domain_checks(Catalog(spark, base)):
        counts = rules.rule_counts(df, rs)
        out = counts if out is None else out.unionByName(counts)
    return out


@query("check_row_rules", "C8", with_ctes(si.SALES_SQL, body="""
SELECT o_orderkey, 'ship_after_order' AS rule FROM sales WHERE NOT coalesce(ship_date >= o_orderdate, true)
UNION ALL
SELECT o_orderkey, 'shipped_has_date' FROM sales
WHERE NOT coalesce(NOT (order_status = 'shipped' AND ship_date IS NULL), true)
UNION ALL
SELECT o_orderkey, 'paid_flag' FROM sales WHERE NOT coalesce(paid IN ('y', 'n'), true)"""))
def check_row_rules(spark, base):
    """Rules over two columns of a row: ship after order, shipped needs a
    ship date, paid flag in its list; one pass, one row per broken rule."""
    s = si.sales(Catalog(spark, base))
    rs = [Rule("ship_after_order", C("ship_date") >= C("o_orderdate")),
          Rule("shipped_has_date", ~((C("order_status") == "shipped") & C("ship_date").isNull())),
          Rule("paid_flag", C("paid").isin("y", "n"))]
    return rules.violations(s, rs, ["o_orderkey"])


@query("check_lookup_range", "C9", with_ctes(si.ORDERS_KEYED_SQL, si.RANGES_SQL, body="""
SELECT o.o_orderkey, CAST(o.price AS DOUBLE) AS price, CAST(r.min_price AS DOUBLE) AS min_price,
       CAST(r.max_price AS DOUBLE) AS max_price
FROM okeyed o JOIN ranges r
  ON r.o_orderstatus = o.o_orderstatus AND r.o_orderpriority = o.o_orderpriority AND r.o_year = o.o_year
WHERE NOT coalesce(o.price BETWEEN r.min_price AND r.max_price, true)"""))
def check_lookup_range(spark, base):
    """Orders priced outside the range of their key (no range row: unknown,
    not a violation)."""
    cat = Catalog(spark, base)
    out = rules.range_violations(si.orders_keyed(cat), si.range_table(cat),
                                 ["o_orderstatus", "o_orderpriority", "o_year"], "price", "min_price", "max_price")
    return out.select("o_orderkey", *[C(c).cast("double").alias(c) for c in ("price", "min_price", "max_price")])


@query("check_cross_table", "C10", with_ctes(si.SALES_SQL, si.CUST_SQL, body="""
SELECT s.o_orderkey, s.o_custkey FROM sales s
WHERE s.order_status = 'shipped'
  AND EXISTS (SELECT 1 FROM cust c WHERE c.c_custkey = s.o_custkey AND c.on_hold = '*')"""))
def check_cross_table(spark, base):
    """Shipped orders of customers on hold."""
    cat = Catalog(spark, base)
    s = si.sales(cat, status="F")  # shipped, tested on the stored letter so that the scan sees it
    held = si.held_customers(cat)
    out = rules.cross_table(s, C("order_status") == "shipped", held, C("on_hold") == "*",
                            s["o_custkey"] == held["c_custkey"])
    return out.select("o_orderkey", "o_custkey")


CONSTRAINTS = (
    ("lineitem", "not_null", "l_returnflag"), ("lineitem", "primary_key", "l_orderkey,l_linenumber"),
    ("lineitem", "foreign_key", "l_orderkey -> orders"), ("lineitem", "check", "l_discount <= 0.08"),
    ("orders", "primary_key", "o_orderkey"), ("orders", "foreign_key", "o_custkey -> customer"),
    ("orders", "foreign_key", "price key -> ranges"), ("orders", "price_range", "price within its range"),
    ("orders", "on_hold", "shipped to a customer on hold"), ("customer", "unique", "c_name"),
    ("customer", "unique", "c_nationkey,c_mktsegment"))


def order_constraints():
    """The constraints named in ``CONSTRAINTS``."""
    a, customer = iter(CONSTRAINTS), ("customer", ("c_custkey",))
    key = ("o_orderstatus", "o_orderpriority", "o_year")
    return [cs.NotNull(*next(a), "l_returnflag"), cs.Key(*next(a), ("l_orderkey", "l_linenumber")),
            cs.Reference(*next(a), ("l_orderkey",), "orders", ("o_orderkey",)), cs.Check(*next(a), C("l_discount") <= 0.08),
            cs.Key(*next(a), ("o_orderkey",)), cs.Reference(*next(a), ("o_custkey",), *customer),
            cs.Reference(*next(a), key, "ranges", key), cs.InRange(*next(a), key, "price", "ranges", key, "min_price", "max_price"),
            cs.Conflict(*next(a), ("o_custkey",), C("o_orderstatus") == "F", *customer, C("on_hold") == "*"),
            cs.Key(*next(a), ("c_name",), null_is_distinct=True), cs.Key(*next(a), ("c_nationkey", "c_mktsegment"), null_is_distinct=True)]


def _label(n: int) -> str:
    return "'{}' AS table_name, '{}' AS kind, '{}' AS constraint_name".format(*CONSTRAINTS[n])


@query("constraint_report", "C1", with_ctes(si.ORDERS_KEYED_SQL, si.RANGES_SQL, si.CUST_SQL, f"""
kept AS (SELECT * FROM cust WHERE c_mktsegment <> '{si.LOST_PARENT_SEGMENT}')""", body=f"""
SELECT {_label(0)}, count(*) AS n_violations FROM lineitem WHERE nullif(l_returnflag, 'R') IS NULL
UNION ALL SELECT {_label(1)}, count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT {_label(2)}, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM okeyed)
UNION ALL SELECT {_label(3)}, count(*) FROM lineitem WHERE l_discount > CAST(0.08 AS DOUBLE)
UNION ALL SELECT {_label(4)}, count(*) FROM (SELECT 1 FROM okeyed GROUP BY o_orderkey HAVING count(*) > 1)
UNION ALL SELECT {_label(5)}, count(*) FROM okeyed WHERE o_custkey NOT IN (SELECT c_custkey FROM kept)
UNION ALL SELECT {_label(6)}, count(*) FROM okeyed o WHERE NOT EXISTS (SELECT 1 FROM ranges r WHERE r.o_orderstatus = o.o_orderstatus
    AND r.o_orderpriority = o.o_orderpriority AND r.o_year = o.o_year)
UNION ALL SELECT {_label(7)}, count(*) FROM okeyed JOIN ranges USING (o_orderstatus, o_orderpriority, o_year)
    WHERE price NOT BETWEEN min_price AND max_price
UNION ALL SELECT {_label(8)}, count(*) FROM okeyed WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM kept WHERE on_hold = '*')
UNION ALL SELECT {_label(9)}, count(*) FROM (SELECT 1 FROM kept GROUP BY c_name HAVING count(*) > 1)
UNION ALL SELECT {_label(10)}, count(*) FROM (SELECT 1 FROM kept GROUP BY c_nationkey, c_mktsegment HAVING count(*) > 1)"""))
def constraint_report(spark, base):
    """Keys, references, ranges, rules and a rule across tables over four
    tables at once: one scan and one shuffle of each."""
    cat = Catalog(spark, base)
    lines = cat.lineitem.withColumn("l_returnflag", F.nullif(C("l_returnflag"), F.lit("R")))
    customers = si.held_customers(cat).where(C("c_mktsegment") != si.LOST_PARENT_SEGMENT)
    return cs.report({"lineitem": lines, "orders": si.orders_keyed(cat), "customer": customers, "ranges": si.price_ranges(cat)},
                     order_constraints())


# ============================================================================ D


@query("audit_changes", "D1", with_ctes(si.ORDERS_KEYED_SQL, si.PRICE_UPDATES_SQL, body=f"""
SELECT o.o_orderkey, {si.AS_OF_SQL} AS change_date, 'auditor' AS updater_id,
       CAST(o.price AS DOUBLE) AS old_value, CAST(n.price AS DOUBLE) AS new_value,
       (CAST(n.price AS DOUBLE) - CAST(o.price AS DOUBLE)) * CAST(100.0 AS DOUBLE)
         / nullif(CAST(o.price AS DOUBLE), 0) AS percent_change
FROM okeyed o JOIN s4 n ON n.o_orderkey = o.o_orderkey
WHERE o.price <> n.price"""))
def audit_changes(spark, base):
    """Audit rows of the ordered price updates, in trigger form: old and new
    value of a row are seen together, without a join."""
    return audit.audit_update(si.orders_keyed(Catalog(spark, base)), ["o_orderkey"], "price", si.price_update_steps(),
                              si.AS_OF, "auditor")[1]


@query("audit_snapshots", "D1", with_ctes(si.ORDERS_KEYED_SQL, si.PRICE_UPDATES_SQL, body=f"""
SELECT o.o_orderkey, {si.AS_OF_SQL} AS change_date, 'auditor' AS updater_id,
       CAST(o.price AS DOUBLE) AS old_value, CAST(n.price AS DOUBLE) AS new_value,
       (CAST(n.price AS DOUBLE) - CAST(o.price AS DOUBLE)) * CAST(100.0 AS DOUBLE)
         / nullif(CAST(o.price AS DOUBLE), 0) AS percent_change
FROM okeyed o JOIN s4 n ON n.o_orderkey = o.o_orderkey
WHERE o.price <> n.price"""))
def audit_snapshots(spark, base):
    """Audit rows between two stored snapshots of orders, before and after the
    ordered price updates."""
    old = stored(si.orders_keyed(Catalog(spark, base)), "snapshot")
    new = stored(changes.update_sequence(old, si.price_update_steps()), "snapshot")
    return audit.audit_changes(old, new, ["o_orderkey"], "price", si.AS_OF, "auditor")


@query("audit_stream", "D1", with_ctes(si.ORDERS_KEYED_SQL, si.PRICE_UPDATES_SQL, body=f"""
SELECT o_orderkey, {si.AS_OF_SQL} AS change_date, 'auditor' AS updater_id, old AS old_value, new AS new_value,
       (new - old) * CAST(100.0 AS DOUBLE) / nullif(old, 0) AS percent_change
FROM (SELECT o.o_orderkey, CAST(o.price AS DOUBLE) AS old, CAST(m.price AS DOUBLE) AS new
        FROM okeyed o JOIN s2 m ON m.o_orderkey = o.o_orderkey
      UNION ALL
      SELECT m.o_orderkey, CAST(m.price AS DOUBLE), CAST(n.price AS DOUBLE) FROM s2 m JOIN s4 n ON n.o_orderkey = m.o_orderkey) t
WHERE old <> new"""))
def audit_stream(spark, base):
    """Three versions of all orders arrive as files, before, between and after
    the ordered price updates; the stream audits each change as it sees it."""
    path, orders, steps = scratch_path(spark, "order_versions"), si.orders_keyed(Catalog(spark, base)), si.price_update_steps()
    for version, done in enumerate((0, 2, 4)):
        (changes.update_sequence(orders, steps[:done]).select("o_orderkey", "price", F.lit(version).alias("version"))
         .write.mode("append").parquet(path))
    schema = spark.read.parquet(path).schema
    return audit_files(spark, path, schema, ["o_orderkey"], "price", "version", si.AS_OF, "auditor", max_files_per_trigger=1)


@query("stream_new_rows", "D2", """
SELECT event_type, count(*) AS n_new FROM events GROUP BY event_type""")
def stream_new_rows(spark, base):
    """The events table as a growing file source: the stream's notices,
    read back, must count every row once (the SQL is that batch count)."""
    return new_rows.new_row_counts(spark, tables.table_path(base, "events"), tables.SCHEMAS["events"], "event_type")
