"""Data quality rules over the TPC-H-like tables, one of each constructor and more."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as dq
from ..operators import staging
from .registry import query, read, views
from .staging import _JUDGED, CONTRACT, raw

PARAMETERS = {"as_of": "2001-06-01", "grace": 90, "max_quantity": 50}


def _late_lines(spark, parameters):
    """A rule as a function: every order's lines ship within the grace after the order."""
    joined = spark.table("orders").join(spark.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    gap = F.datediff("l_shipdate", "o_orderdate")
    return joined.groupBy("o_orderkey").agg(F.max(gap).alias("gap")).select(F.col("o_orderkey").alias("record_key"), (F.col("gap") <= parameters["grace"]).alias("passed"), F.col("gap").alias("observed"))


RULES = [
    dq.Rule("DQ-01", "Order date on every order", "completeness", "critical", "orders", "Production Controller", 1.0, dq.not_null("orders", "o_orderkey", "o_orderdate")),
    dq.Rule("DQ-02", "Order has a customer", "integrity", "critical", "orders", "Finance Manager", 1.0, dq.exists_in("orders", "o_orderkey", "o_custkey", "customer", "c_custkey")),
    dq.Rule("DQ-03", "Order has lines", "integrity", "high", "orders", "Production Controller", 0.97, dq.exists_in("orders", "o_orderkey", "o_orderkey", "lineitem", "l_orderkey")),
    dq.Rule("DQ-04", "Customer is in credit", "validity", "medium", "customer", "Finance Manager", 0.95, dq.predicate("customer", "c_custkey", "c_acctbal >= 0")),
    dq.Rule("DQ-05", "Line quantity is plausible", "validity", "high", "lineitem", "Production Controller", 0.99, dq.predicate("lineitem", "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)", "l_quantity > 0 AND l_quantity < ${max_quantity}", "CAST(l_quantity AS INT)")),
    dq.Rule("DQ-06", "Order is not after the extract", "timeliness", "low", "orders", "Production Controller", 1.0, dq.predicate("orders", "o_orderkey", "o_orderdate <= DATE '${as_of}'")),
    dq.Rule("DQ-07", "Order agrees with its lines", "consistency", "high", "orders", "Finance Manager", 0.9, "SELECT o_orderkey AS record_key, abs(o_totalprice - s) <= 0.05 * s AS passed, NULL AS observed FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"),
    dq.Rule("DQ-08", "One line number once", "uniqueness", "high", "lineitem", "Production Controller", 1.0, "SELECT concat_ws('-', l_orderkey, l_linenumber) AS record_key, count(*) = 1 AS passed, count(*) AS observed FROM lineitem GROUP BY l_orderkey, l_linenumber"),
    dq.Rule("DQ-09", "Lines ship in time", "timeliness", "medium", "lineitem", "Production Controller", 0.95, _late_lines),
    dq.Rule("DQ-10", "Label is binary", "validity", "low", "labels", "Quality Manager", 1.0, dq.predicate("labels", "doc_id", "quality IN (0, 1) AND toxic IN (0, 1)")),
    dq.Rule("DQ-11", "A table that is not there", "validity", "low", "labels", "Quality Manager", 1.0, "SELECT a AS record_key, true AS passed, NULL AS observed FROM no_such_table"),
]


def evaluated(spark, sf):
    views(spark, sf, "orders", "customer", "lineitem", "labels")
    dq.validate(RULES)
    return dq.evaluate(spark, RULES, PARAMETERS)


_CHECKS = """
WITH checks AS (
SELECT 'DQ-01' AS rule_id, CAST(o_orderkey AS VARCHAR) AS record_key, o_orderdate IS NOT NULL AS passed, CAST(NULL AS VARCHAR) AS observed FROM orders
UNION ALL SELECT 'DQ-02', CAST(o_orderkey AS VARCHAR), o_custkey IN (SELECT c_custkey FROM customer), CAST(o_custkey AS VARCHAR) FROM orders
UNION ALL SELECT 'DQ-03', CAST(o_orderkey AS VARCHAR), o_orderkey IN (SELECT l_orderkey FROM lineitem), CAST(o_orderkey AS VARCHAR) FROM orders
UNION ALL SELECT 'DQ-04', CAST(c_custkey AS VARCHAR), c_acctbal >= 0, NULL FROM customer
UNION ALL SELECT 'DQ-05', concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey), l_quantity > 0 AND l_quantity < 50, CAST(CAST(l_quantity AS INT) AS VARCHAR) FROM lineitem
UNION ALL SELECT 'DQ-06', CAST(o_orderkey AS VARCHAR), o_orderdate <= DATE '2001-06-01', NULL FROM orders
UNION ALL SELECT 'DQ-07', CAST(o_orderkey AS VARCHAR), coalesce(abs(o_totalprice - s) <= 0.05::DOUBLE * s, false), NULL FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
UNION ALL SELECT 'DQ-08', concat_ws('-', l_orderkey, l_linenumber), count(*) = 1, CAST(count(*) AS VARCHAR) FROM lineitem GROUP BY l_orderkey, l_linenumber
UNION ALL SELECT 'DQ-09', CAST(o_orderkey AS VARCHAR), max(date_diff('day', o_orderdate, l_shipdate)) <= 90, CAST(max(date_diff('day', o_orderdate, l_shipdate)) AS VARCHAR) FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey
UNION ALL SELECT 'DQ-10', CAST(doc_id AS VARCHAR), coalesce(quality IN (0, 1) AND toxic IN (0, 1), false), NULL FROM labels),
rules AS (SELECT * FROM (VALUES ('DQ-01', 'critical', 8, 'orders', 'Production Controller', 1.0), ('DQ-02', 'critical', 8, 'orders', 'Finance Manager', 1.0), ('DQ-03', 'high', 4, 'orders', 'Production Controller', 0.97), ('DQ-04', 'medium', 2, 'customer', 'Finance Manager', 0.95), ('DQ-05', 'high', 4, 'lineitem', 'Production Controller', 0.99), ('DQ-06', 'low', 1, 'orders', 'Production Controller', 1.0), ('DQ-07', 'high', 4, 'orders', 'Finance Manager', 0.9), ('DQ-08', 'high', 4, 'lineitem', 'Production Controller', 1.0), ('DQ-09', 'medium', 2, 'lineitem', 'Production Controller', 0.95), ('DQ-10', 'low', 1, 'labels', 'Quality Manager', 1.0)) AS v(rule_id, severity, weight, system, owner, threshold)),
counted AS (SELECT rule_id, count(*) AS checked, count(*) FILTER (WHERE NOT passed) AS failed FROM checks GROUP BY 1),
rated AS (SELECT rules.*, checked, failed, 1 - CAST(failed AS DOUBLE) / checked AS pass_rate FROM rules JOIN counted USING (rule_id)),
scored AS (SELECT *, pass_rate >= threshold::DOUBLE AS met, least(1.0::DOUBLE, pass_rate / threshold::DOUBLE) AS score FROM rated)
"""


@query("dq_results", _CHECKS + "SELECT rule_id, 'ok' AS status, checked, failed, pass_rate, met, score FROM scored UNION ALL SELECT 'DQ-11', 'error', 0, 0, 1.0::DOUBLE, NULL, NULL")
def dq_results(spark, sf):
    return evaluated(spark, sf).results.select("rule_id", "status", "checked", "failed", "pass_rate", "met", "score")


def _index(by):
    return f"SELECT {by} count(*) AS n_rules, count(*) FILTER (WHERE met) AS n_met, count(*) FILTER (WHERE severity = 'critical' AND NOT met) AS critical_breaches, CAST(sum(checked) AS BIGINT) AS checked, CAST(sum(failed) AS BIGINT) AS failed, CAST(100 * sum(weight * score) / sum(weight) AS DECIMAL(9,4)) AS index FROM scored"


@query("dq_index", _CHECKS + _index(""))
def dq_index(spark, sf):
    return dq.index(evaluated(spark, sf).results).withColumn("index", F.col("index").cast("decimal(9,4)"))


@query("dq_scorecard", _CHECKS + _index("owner,") + " GROUP BY owner")
def dq_scorecard(spark, sf):
    return dq.index(evaluated(spark, sf).results, ["owner"]).withColumn("index", F.col("index").cast("decimal(9,4)"))


@query("dq_exceptions", _CHECKS + "SELECT rule_id, row_number() OVER (PARTITION BY rule_id ORDER BY record_key, observed NULLS FIRST) AS place, record_key, observed, severity, owner FROM checks JOIN rules USING (rule_id) WHERE NOT passed")
def dq_exceptions(spark, sf):
    return dq.exceptions(evaluated(spark, sf)).drop("source_file", "source_row")


#: A rule of each shape that the first set lacks; the last breaks on its rows and so isn't scored.
SHAPES = [
    dq.Rule("DQ-21", "One segment per nation", "consistency", "medium", "customer", "Finance Manager", 1.0, dq.one_value("customer", "c_nationkey", "c_mktsegment")),
    dq.Rule("DQ-22", "One row per order", "uniqueness", "high", "orders", "Production Controller", 1.0, dq.unique("orders", "o_orderkey")),
    dq.Rule("DQ-23", "Status fits the return flag", "validity", "high", "lineitem", "Quality Manager", 0.9, dq.by_kind("lineitem", "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)", "l_returnflag", "l_linestatus", {"R": ("F",), "N": ("O", "F")}, ("F",))),
    dq.Rule("DQ-24", "Orders are before the extract", "timeliness", "low", "orders", "Production Controller", 1.0, dq.in_order("orders", "o_orderkey", "CAST(o_orderdate AS DATE)", "DATE '${as_of}'")),
    dq.Rule("DQ-25", "Order agrees with its lines", "accuracy", "high", "orders", "Finance Manager", 0.9, dq.agrees("orders", "o_orderkey", "o_totalprice", "lineitem", "l_orderkey", "l_extendedprice", 0.25)),
    dq.Rule("DQ-26", "Nothing ships long after the order", "timeliness", "medium", "orders", "Production Controller", 0.9, dq.none_after("(SELECT o_orderkey, o_orderdate + INTERVAL 100 DAYS AS closes FROM orders)", "o_orderkey", "closes", "lineitem", "l_orderkey", "l_shipdate")),
    dq.Rule("DQ-27", "Orders and lines know each other", "integrity", "critical", "orders", "Production Controller", 1.0, dq.both_ways("orders", "o_orderkey", "lineitem", "l_orderkey")),
    dq.Rule("DQ-28", "Names are there", "completeness", "critical", "customer", "Finance Manager", 1.0, dq.all_of(dq.not_null("customer", "c_custkey", "c_name"), dq.not_null("supplier", "s_suppkey", "s_name"))),
    dq.Rule("DQ-29", "Price is near the list price", "accuracy", "low", "lineitem", "Finance Manager", 0.5, dq.within("part", "p_partkey", "p_retailprice", "1000", "0.3")),
    dq.Rule("DQ-31", "Started orders have lines", "integrity", "high", "orders", "Production Controller", 1.0, dq.has_child("orders", "o_orderkey", "lineitem", "l_orderkey", "p.o_orderstatus <> 'O'")),
    dq.Rule("DQ-32", "Dates in sequence", "consistency", "medium", "orders", "Production Controller", 0.95, dq.in_sequence("orders", "o_orderkey", ("o_orderdate",), (("lineitem", "l_orderkey", "l_shipdate"), ("(SELECT * FROM lineitem WHERE l_linestatus = 'F')", "l_orderkey", "l_shipdate")))),
    dq.Rule("DQ-33", "Parts resolved by code", "consistency", "low", "part", "Quality Manager", 0.9, dq.recorded_as("part", "p_partkey", {"p_brand": "brand", "p_type": "type"}, "(SELECT DISTINCT p_brand AS brand, p_type AS type, CASE WHEN length(p_type) % 3 = 0 THEN 'exact' ELSE 'parsed' END AS method FROM part)", "method", ("exact",), "x.method")),
    dq.Rule("DQ-34", "One supplier a nation", "uniqueness", "low", "supplier", "Finance Manager", 0.5, dq.one_code("supplier", "s_suppkey", "s_nationkey", "s_acctbal > 0", "SELECT s_suppkey AS code FROM supplier WHERE s_suppkey % 7 = 0")),
    dq.Rule("DQ-30", "A check that breaks on its rows", "validity", "low", "customer", "Quality Manager", 1.0, "SELECT c_custkey AS record_key, CAST(c_name AS INT) > 0 AS passed, NULL AS observed FROM customer"),
]

_SHAPES = """
WITH checks AS (
SELECT 'DQ-21' AS rule_id, count(DISTINCT c_mktsegment) <= 1 AS passed FROM customer GROUP BY c_nationkey
UNION ALL SELECT 'DQ-22', count(*) = 1 FROM orders GROUP BY o_orderkey
UNION ALL SELECT 'DQ-23', CASE l_returnflag WHEN 'R' THEN l_linestatus = 'F' WHEN 'N' THEN l_linestatus IN ('O', 'F') ELSE l_linestatus = 'F' END FROM lineitem
UNION ALL SELECT 'DQ-24', coalesce(CAST(o_orderdate AS DATE) <= DATE '2001-06-01', true) FROM orders
UNION ALL SELECT 'DQ-25', coalesce(abs(CAST(o_totalprice AS DOUBLE) - s) <= 0.25::DOUBLE * abs(s), false) FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
UNION ALL SELECT 'DQ-26', coalesce(max(l_shipdate) <= o_orderdate + INTERVAL 100 DAYS, true) FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate
UNION ALL SELECT 'DQ-27', o_orderkey IS NOT NULL AND l_orderkey IS NOT NULL FROM (SELECT DISTINCT o_orderkey FROM orders) FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey
UNION ALL SELECT 'DQ-28', c_name IS NOT NULL FROM customer UNION ALL SELECT 'DQ-28', s_name IS NOT NULL FROM supplier
UNION ALL SELECT 'DQ-31', o_orderkey IN (SELECT l_orderkey FROM lineitem) FROM orders WHERE o_orderstatus <> 'O'
UNION ALL SELECT 'DQ-32', coalesce(o_orderdate <= s, true) AND coalesce(s <= f, true) FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS s, min(l_shipdate) FILTER (WHERE l_linestatus = 'F') AS f FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
UNION ALL SELECT 'DQ-33', length(p_type) % 3 = 0 FROM part
UNION ALL SELECT 'DQ-34', count(*) OVER (PARTITION BY s_nationkey) <= 1 AND s_suppkey % 7 <> 0 FROM supplier WHERE s_acctbal > 0
UNION ALL SELECT 'DQ-29', abs(p_retailprice - 1000) <= 0.3::DOUBLE * 1000 FROM part)
"""


@query("dq_quarantined", _JUDGED + """SELECT 'readings.csv:' || _source_row AS record_key, rule_id, NOT coalesce(hit, false) AS passed, 'readings.csv' AS source_file, _source_row AS source_row FROM (
SELECT 'DQ-19' AS rule_id, _source_row, rule = 'ST-02' AS hit FROM judged UNION ALL SELECT 'DQ-20', _source_row, rule IN ('ST-03', 'ST-04', 'ST-05', 'ST-06', 'ST-07') FROM judged UNION ALL SELECT 'DQ-21', _source_row, rule = 'ST-08' FROM judged) AS v""")
def dq_quarantined(spark, sf):
    """Rows as received that the staging rules have rejected, by the rules that say so, with their file and line."""
    received = raw(spark, sf)
    received.createOrReplaceTempView("raw_readings")
    staging.quarantine(staging.judge(received, CONTRACT)).createOrReplaceTempView("quarantined")
    found = dq.evaluate(spark, [dq.Rule(i, "Readable", "validity", "high", "shop_floor", "Production Controller", 1.0, dq.not_quarantined(("raw_readings",), "quarantined", rules)) for i, rules in (("DQ-19", ("ST-02",)), ("DQ-20", ("ST-03", "ST-04", "ST-05", "ST-06", "ST-07")), ("DQ-21", ("ST-08",)))])
    return found.checks.drop("observed")


@query("dq_shapes", _SHAPES + "SELECT rule_id, 'ok' AS status, count(*) AS checked, count(*) FILTER (WHERE NOT passed) AS failed FROM checks GROUP BY 1 UNION ALL SELECT 'DQ-30', 'error', 0, 0")
def dq_shapes(spark, sf):
    views(spark, sf, "orders", "customer", "lineitem", "supplier", "part")
    dq.validate(SHAPES)
    return dq.evaluate(spark, SHAPES, PARAMETERS).results.select("rule_id", "status", "checked", "failed")
