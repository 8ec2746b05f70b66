"""Conformed tables: nations as sites under aliases, customers' orders as jobs, lines as invoices, and what was matched."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conformance
from .registry import query, read

_WRITTEN = "CASE c_custkey % 4 WHEN 0 THEN upper(n_name) || ' WORKS' WHEN 1 THEN '  ' || lower(n_name) || '  works ' WHEN 2 THEN n_name ELSE 'yard ' || n_name END"


@query("site_alias", f"""
WITH w AS (SELECT c_custkey, n_name, {_WRITTEN} AS written FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, written, CASE WHEN c_custkey % 4 < 3 THEN n_name END AS site, c_custkey % 4 < 3 AS matched FROM w""")
def site_alias(spark, sf):
    nation = read(spark, sf, "nation")
    aliases = nation.select(F.concat("n_name", F.lit(" works")).alias("alias"), F.col("n_name").alias("canonical")).unionByName(nation.select(F.col("n_name").alias("alias"), F.col("n_name").alias("canonical")))
    written = read(spark, sf, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.expr(_WRITTEN).alias("written"))
    out = conformance.with_alias(written, "written", aliases, "site").withColumn("matched", F.col("site").isNotNull())
    conformance.assert_no_row_lost(written, out)
    return out


_ORDERS = "SELECT o_orderkey, o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(14,2)) AS value FROM orders"


@query("jobs_rolled_up", f"""
WITH o AS ({_ORDERS}), votes AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM o GROUP BY 1, 2), modes AS (SELECT o_custkey, arg_min(o_orderpriority, (-n, o_orderpriority)) AS o_orderpriority FROM votes GROUP BY 1)
SELECT o_custkey AS job, m.o_orderpriority AS priority, count(*) AS n_orders, min(day) AS first_order, max(day) AS last_order, CAST(sum(value) AS DOUBLE) AS value, bool_or(c_custkey IS NOT NULL) AS has_customer
FROM o JOIN modes m USING (o_custkey) LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""")
def jobs_rolled_up(spark, sf):
    orders = read(spark, sf, "orders").select("o_custkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").cast("decimal(14,2)").alias("value"))
    jobs = conformance.roll_up(orders, "o_custkey", "o_orderpriority", F.count("*").alias("n_orders"), F.min("day").alias("first_order"), F.max("day").alias("last_order"), F.sum("value").cast("double").alias("value"))
    known = conformance.with_parent(jobs, "o_custkey", read(spark, sf, "customer"), "c_custkey", "has_customer")
    return known.select(F.col("o_custkey").alias("job"), F.col("o_orderpriority").alias("priority"), "n_orders", "first_order", "last_order", "value", "has_customer")


@query("finance_jobs", """
SELECT 'J' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS finance_code, o_custkey AS job, count(*) AS n_invoices, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS invoiced, count(DISTINCT l_suppkey) AS n_suppliers, max(CAST(l_shipdate AS DATE)) AS last_invoice
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'F' GROUP BY o_custkey""")
def finance_jobs(spark, sf):
    orders = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("job"))
    lines = read(spark, sf, "lineitem").filter("l_linestatus = 'F'").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    money = F.col("l_extendedprice").cast("decimal(12,2)")
    summed = lines.groupBy("job").agg(F.count("*").alias("n_invoices"), F.sum(money).cast("double").alias("invoiced"), F.count_distinct("l_suppkey").alias("n_suppliers"), F.max(F.col("l_shipdate").cast("date")).alias("last_invoice"))
    return summed.withColumn("finance_code", F.concat(F.lit("J"), F.lpad(F.col("job").cast("string"), 6, "0")))


_PO = "CASE WHEN l_linenumber = 6 THEN l_orderkey + 100000000 WHEN l_linenumber <> 7 THEN l_orderkey END"


@query("conformance_checks", f"""
WITH f AS (SELECT ({_PO}) IN (SELECT o_orderkey FROM orders) IS TRUE AS order_matched, l_partkey % 11 IN (SELECT p_size FROM part) IS TRUE AS size_matched, l_suppkey IN (SELECT s_suppkey FROM supplier) IS TRUE AS supplier_matched FROM lineitem)
SELECT 'order_matched' AS check, count(*) FILTER (WHERE order_matched) AS matched, count(*) FILTER (WHERE NOT order_matched) AS unmatched FROM f UNION ALL SELECT 'size_matched', count(*) FILTER (WHERE size_matched), count(*) FILTER (WHERE NOT size_matched) FROM f
UNION ALL SELECT 'supplier_matched', count(*) FILTER (WHERE supplier_matched), count(*) FILTER (WHERE NOT supplier_matched) FROM f""")
def conformance_checks(spark, sf):
    lines = read(spark, sf, "lineitem").select(F.expr(_PO).alias("po"), (F.col("l_partkey") % 11).alias("size"), "l_suppkey")
    flagged = conformance.with_parent(lines, "po", read(spark, sf, "orders"), "o_orderkey", "order_matched")
    flagged = conformance.with_parent(flagged, "size", read(spark, sf, "part"), "p_size", "size_matched")
    flagged = conformance.with_parent(flagged, "l_suppkey", read(spark, sf, "supplier"), "s_suppkey", "supplier_matched")
    return conformance.coverage(flagged, ["order_matched", "size_matched", "supplier_matched"])
