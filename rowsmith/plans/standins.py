"""Stand-in inputs built from the test tables.

The jobs of this library act on shapes the test tables do not have as such:
a parent-child tree, a sales table with ship dates and a paid flag, a table of
allowed ranges on a composite key, two snapshots of one table, rows without a
key. Each builder below only reshapes test-table rows into that schema; the
job that runs on it (rollup, checks, audit, ...) does all the work and uses
nothing of how the rows were made. Every builder has its SQL twin, used by
the DuckDB oracle, with the same columns and the same values.

Natural attributes pick the special rows (a market segment, a negative
balance, a priority), never id arithmetic, except where a tree needs parent
links at all: ``key div fanout`` is only how the test rows get a parent.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.operators.aggregates import MONEY
from rowsmith.session import stored_lookup
from rowsmith.sources.tables import Catalog

# Fixed parameters of the stand-ins and of the jobs run on them.
AS_OF = dt.datetime(2000, 1, 1)
AS_OF_SQL = "TIMESTAMP '2000-01-01 00:00:00'"
UNPAID_PRIORITIES = ("4-NOT SPECIFIED", "5-LOW")
UNMANAGED_SEGMENT = "MACHINERY"
LOST_PARENT_SEGMENT = "AUTOMOBILE"
NO_RANGE_KEY = ("P", 1998)  # (status, order year) with no range row


# ----------------------------------------------------------------------------
# sales: orders with a ship date (latest line shipped), a paid flag, a status
# name and a decimal value
def sales(cat: Catalog, status: str | None = None) -> DataFrame:
    """All sales, or those of one stored status letter (the test then reaches the scan of orders)."""
    o, li = cat.orders, cat.lineitem
    if status is not None:
        o = o.where(F.col("o_orderstatus") == status)
    ship = li.groupBy(F.col("l_orderkey").alias("__ok")).agg(F.max("l_shipdate").alias("ship_date"))
    named = F.when(F.col("o_orderstatus") == "F", "shipped").when(F.col("o_orderstatus") == "O", "open") \
              .otherwise("waiting")
    return (o.join(ship, o["o_orderkey"] == ship["__ok"], "left")
             .select("o_orderkey", "o_custkey", "o_orderstatus", named.alias("order_status"),
                     "o_orderdate", "ship_date", "o_orderpriority",
                     F.when(F.col("o_orderpriority").isin(*UNPAID_PRIORITIES), "n").otherwise("y").alias("paid"),
                     F.col("o_totalprice").cast(MONEY).alias("total_value")))


SALES_SQL = f"""sales AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus,
         CASE o.o_orderstatus WHEN 'F' THEN 'shipped' WHEN 'O' THEN 'open' ELSE 'waiting' END AS order_status,
         o.o_orderdate, s.ship_date, o.o_orderpriority,
         CASE WHEN o.o_orderpriority IN {UNPAID_PRIORITIES!r} THEN 'n' ELSE 'y' END AS paid,
         CAST(o.o_totalprice AS DECIMAL(12,2)) AS total_value
  FROM orders o
  LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS ship_date FROM lineitem GROUP BY l_orderkey) s
    ON s.l_orderkey = o.o_orderkey)"""


# ----------------------------------------------------------------------------
# customers with an on-hold mark (negative balance)
def held_customers(cat: Catalog) -> DataFrame:
    c = cat.customer
    return c.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal",
                    F.when(F.col("c_acctbal") < 0, F.lit("*")).alias("on_hold"))


CUST_SQL = """cust AS (
  SELECT c_custkey, c_name, c_nationkey, c_mktsegment, c_acctbal,
         CASE WHEN c_acctbal < 0 THEN '*' END AS on_hold
  FROM customer)"""


# ----------------------------------------------------------------------------
# trees: customer (fan-out 10, root 0) and part (fan-out 2, root 0)
def customer_tree(cat: Catalog) -> DataFrame:
    c = cat.customer
    return c.select(F.col("c_custkey").alias("node"),
                    F.when(F.col("c_custkey") != 0, F.expr("c_custkey div 10")).alias("parent"),
                    F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"),
                    F.col("c_acctbal").alias("value"))


CUST_TREE_SQL = """ctree AS (
  SELECT c_custkey AS node, CASE WHEN c_custkey <> 0 THEN c_custkey // 10 END AS parent,
         c_name AS name, c_mktsegment AS segment, c_acctbal AS value
  FROM customer)"""


def part_tree(cat: Catalog) -> DataFrame:
    p = cat.part
    return p.select(F.col("p_partkey").alias("node"),
                    F.when(F.col("p_partkey") != 0, F.expr("p_partkey div 2")).alias("parent"),
                    F.col("p_name").alias("name"), F.col("p_type").alias("ptype"),
                    F.when(F.col("p_size") != 50, F.col("p_retailprice")).alias("value"))


PART_TREE_SQL = """ptree AS (
  SELECT p_partkey AS node, CASE WHEN p_partkey <> 0 THEN p_partkey // 2 END AS parent,
         p_name AS name, p_type AS ptype,
         CASE WHEN p_size <> 50 THEN p_retailprice END AS value
  FROM part)"""


# ----------------------------------------------------------------------------
# allowed price ranges per (status, priority, order year), one key left out
def price_ranges(cat: Catalog) -> DataFrame:
    o = cat.orders
    keys = o.select("o_orderstatus", "o_orderpriority",
                    F.year("o_orderdate").alias("o_year")).distinct()
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    return (keys.where(~((F.col("o_orderstatus") == NO_RANGE_KEY[0]) & (F.col("o_year") == NO_RANGE_KEY[1])))
                .select("o_orderstatus", "o_orderpriority", "o_year",
                        (digit * 1000).cast(MONEY).alias("min_price"),
                        (digit * 20000 + 300000).cast(MONEY).alias("max_price")))


def range_table(cat: Catalog) -> DataFrame:
    """The price ranges as the small table they are: written once to the
    shared folder, counted and checked for unique keys by that job, and marked
    for broadcast when small enough."""
    return stored_lookup(price_ranges(cat), ["o_orderstatus", "o_orderpriority", "o_year"], "price_ranges")


RANGES_SQL = f"""ranges AS (
  SELECT o_orderstatus, o_orderpriority, o_year,
         CAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 1000 AS DECIMAL(12,2)) AS min_price,
         CAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 20000 + 300000 AS DECIMAL(12,2)) AS max_price
  FROM (SELECT DISTINCT o_orderstatus, o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS o_year FROM orders) k
  WHERE NOT (o_orderstatus = '{NO_RANGE_KEY[0]}' AND o_year = {NO_RANGE_KEY[1]}))"""


def orders_keyed(cat: Catalog) -> DataFrame:
    """Orders with the composite range key and a decimal price."""
    return cat.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
                             F.year("o_orderdate").alias("o_year"), "o_orderdate",
                             F.col("o_totalprice").cast(MONEY).alias("price"))


ORDERS_KEYED_SQL = """okeyed AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS o_year,
         o_orderdate, CAST(o_totalprice AS DECIMAL(12,2)) AS price
  FROM orders)"""


# ----------------------------------------------------------------------------
# the ordered price updates (M2) whose before/after snapshots feed the audit
def price_update_steps():
    """(column, predicate, value) steps over ``orders_keyed`` columns; later
    steps see earlier results (the third reads the raised prices)."""
    from rowsmith.functions.scalars import raise_by_percent
    return [
        ("price", F.col("o_orderpriority") == "1-URGENT", raise_by_percent("price", "5")),
        ("price", F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"),
         raise_by_percent("price", "10")),
        ("price", (F.col("o_orderstatus") == "P") & (F.col("price") > 400000),
         (F.col("price") - F.lit(1000)).cast(MONEY)),
        ("price", F.col("o_orderpriority") == "5-LOW", raise_by_percent("price", "-2.5")),
    ]


PRICE_UPDATES_SQL = """
  -- step 1..4 as nested CASEs, each reading the previous step's value
  s1 AS (SELECT * REPLACE (CASE WHEN o_orderpriority = '1-URGENT'
                          THEN CAST(round(price * CAST('1.05' AS DECIMAL(9,4)), 2) AS DECIMAL(12,2))
                          ELSE price END AS price) FROM okeyed),
  s2 AS (SELECT * REPLACE (CASE WHEN o_orderdate < TIMESTAMP '1996-01-01'
                          THEN CAST(round(price * CAST('1.1' AS DECIMAL(9,4)), 2) AS DECIMAL(12,2))
                          ELSE price END AS price) FROM s1),
  s3 AS (SELECT * REPLACE (CASE WHEN o_orderstatus = 'P' AND price > 400000
                          THEN CAST(price - 1000 AS DECIMAL(12,2)) ELSE price END AS price) FROM s2),
  s4 AS (SELECT * REPLACE (CASE WHEN o_orderpriority = '5-LOW'
                          THEN CAST(round(price * CAST('0.975' AS DECIMAL(9,4)), 2) AS DECIMAL(12,2))
                          ELSE price END AS price) FROM s3)"""


# ----------------------------------------------------------------------------
# words of a part name as a fixed array of 5 slots (NULL array for size 1)
def part_words(cat: Catalog) -> DataFrame:
    from rowsmith.functions.arrays import fixed_slots
    p = cat.part
    return p.select("p_partkey", "p_type", "p_brand",
                    F.when(F.col("p_size") != 1, fixed_slots(F.split("p_name", " "), 5)).alias("words"))


def part_word_list(cat: Catalog) -> DataFrame:
    """All words of a part name, however many (NULL for size 1)."""
    return cat.part.select("p_partkey", F.when(F.col("p_size") != 1, F.split("p_name", " ")).alias("words"))


PART_WORD_LIST_SQL = """pwords AS (
  SELECT p_partkey, CASE WHEN p_size <> 1 THEN string_split(p_name, ' ') END AS words FROM part)"""


PART_WORDS_SQL = """pwords AS (
  SELECT p_partkey, p_type, p_brand,
         CASE WHEN p_size <> 1 THEN
           list_resize(string_split(p_name, ' '), 5, ' ')
         END AS words
  FROM part)"""
