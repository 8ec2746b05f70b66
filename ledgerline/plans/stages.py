"""The stages run over tables that are published first: each query publishes its inputs, runs a stage and reads what it has published."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import stages
from ..operators.components import scratch, shared_folder, stored
from ..sources import publish
from . import marts as mart_plans
from . import reconciliation
from .quality import _CHECKS, _SHAPES, PARAMETERS, RULES, SHAPES
from .registry import ORACLES, query, read

#: Rules that are SQL over published tables; the others are functions, or break.
STAGED_RULES = [r for r in (*RULES, *SHAPES) if isinstance(r.check, str) and r.id not in ("DQ-11", "DQ-30")]
COMMENTS = {name: text for k in mart_plans.KPIS for name, text in k.views.items()}


class _Published:
    """A root of its own in the shared folder, with tables published as stage ``core``; gone, with what its stages have stored, when the result has been read."""

    def __init__(self, spark, **tables):
        self.spark, self.root = spark, f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"
        self.add("core", **tables)

    def add(self, stage, **tables):
        with scratch(self.root):
            publish.publish(self.spark, self.root, stage, tables, stage=stage)

    def run(self, stage, *arguments):
        with scratch(self.root):
            return stage(self.spark, self.root, *arguments)

    def taken(self, df):
        return self.gone(stored(df))

    def gone(self, out):
        publish.delete(self.spark, self.root)
        return out

    def read(self, name):
        return publish.read_published(self.spark, self.root, name)


@query("stage_quality", _CHECKS + """, others AS (SELECT * FROM (""" + _SHAPES.replace("WITH checks AS (", "SELECT * FROM (", 1) + """) AS v)
SELECT rule_id, checked, failed, pass_rate >= threshold::DOUBLE AS met FROM rated WHERE rule_id NOT IN ('DQ-09')
UNION ALL SELECT rule_id, count(*), count(*) FILTER (WHERE NOT passed), 1 - CAST(count(*) FILTER (WHERE NOT passed) AS DOUBLE) / count(*) >= CASE WHEN rule_id IN ('DQ-23', 'DQ-25', 'DQ-26', 'DQ-33') THEN 0.9::DOUBLE WHEN rule_id = 'DQ-32' THEN 0.95::DOUBLE WHEN rule_id IN ('DQ-29', 'DQ-34') THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END FROM others GROUP BY rule_id""")
def stage_quality(spark, sf):
    """Results of the quality stage as published."""
    at = _Published(spark, **{t: read(spark, sf, t) for t in ("orders", "customer", "lineitem", "labels", "supplier", "part")})
    at.run(stages.run_quality, STAGED_RULES, PARAMETERS)
    return at.taken(at.read("dq_results").select("rule_id", "checked", "failed", "met"))


@query("stage_scorecard", ORACLES["kpi_scorecard"])
def stage_scorecard(spark, sf):
    at = _Published(spark, **{t: read(spark, sf, t) for t in ("orders", "lineitem")})
    at.run(stages.build_marts, mart_plans.VIEWS, mart_plans.KPIS)
    return at.taken(at.read("kpi_scorecard"))


@query("mart_catalogue", "SELECT 'mart_lines' AS name, '" + COMMENTS["mart_lines"] + "' AS comment, 4 AS n_columns, count(*) AS n_rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'mart_returns', '" + COMMENTS["mart_returns"] + "', 2, 1")
def mart_catalogue(spark, sf):
    """The views of the marts stage, as the catalogue describes them, with the rows they give."""
    at = _Published(spark, **{t: read(spark, sf, t) for t in ("orders", "lineitem")})
    at.run(stages.build_marts, mart_plans.VIEWS, mart_plans.KPIS)
    listed = at.read("mart_views")
    database = listed.first()["database"]
    counts = [spark.table(f"{database}.{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n_rows")) for name in mart_plans.VIEWS]
    return at.taken(listed.join(counts[0].unionByName(counts[1]), "name").drop("database"))


#: Orders and invoices as if received in two files, a line each. SQL that both engines read.
_RECEIVED = """
SELECT 'orders.csv' AS _source_file, CAST(o_orderkey + 2 AS INT) AS _source_row, concat_ws(',', o_orderkey, o_custkey, o_orderstatus) AS line FROM orders
UNION ALL SELECT 'invoices.csv', CAST(l_orderkey * 10 + l_linenumber AS INT), concat_ws(',', l_orderkey, l_linenumber, l_partkey, l_returnflag) FROM lineitem"""


def _reconciled(spark, sf):
    """The tables that the reconciliation stage reads, published."""
    origin = lambda df, file, row: df.withColumns({"_source_file": F.lit(file), "_source_row": F.expr(row).cast("int")})
    lines = origin(reconciliation.three_way_lines(spark, sf).withColumnRenamed("o_orderkey", "order_id").drop("o_orderpriority"), "orders.csv", "order_id + 2")
    invoices = origin(reconciliation._invoices(spark, sf).withColumn("line_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")), "invoices.csv", "l_orderkey * 10 + l_linenumber").drop("l_orderkey", "l_linenumber", "l_partkey").sortWithinPartitions("_source_row")
    part = read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("job"), F.when(F.col("p_size") % 2 == 0, "material").otherwise("labour").alias("component"), F.col("p_retailprice").cast("decimal(12,2)").alias("price"))
    planned = part.select("job", F.lit("planned").alias("side"), "component", (F.col("price") * 10).cast("decimal(18,2)").alias("amount"))
    booked = read(spark, sf, "lineitem").filter("l_linestatus = 'F'").join(part, "l_partkey").select("job", F.lit("actual").alias("side"), "component", F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    supply, demand = reconciliation._sides(spark, sf)
    key = F.col("l_partkey")
    paper = lambda every: F.when(F.col("supply_id") % every != 0, "on file")
    steel = F.when(key % 3 == 0, "S355J2").otherwise("S275JR")
    receipts = supply.select(key.alias("key"), (key * 1000000000 + F.col("supply_id")).alias("supply_id"), "at", "quantity", steel.alias("grade"), paper(17).alias("heat_number"), paper(11).alias("mill_cert_ref")).sortWithinPartitions("key", "supply_id")
    line = key * 1000000000 + F.col("demand_id")
    issues = demand.select(
        key.alias("key"), line.alias("demand_id"), (key % 50).alias("job"), "at", (F.col("at") + F.expr("INTERVAL 30 DAYS")).alias("deadline"), "quantity", (key % 5 == 0).alias("unconfirmed"), (line % 2 == 0).alias("finished"), (line % 3 != 0).alias("despatched"),
        F.when(key % 4 == 1, "EXC3").when(key % 4 != 0, "EXC2").alias("execution_class"), steel.alias("grade"),
    ).sortWithinPartitions("key", "demand_id")
    sales = read(spark, sf, "customer").filter("c_custkey < 40").select(F.col("c_custkey").alias("job"), F.col("c_mktsegment").alias("customer"), F.col("c_acctbal").cast("decimal(12,2)").alias("sales_value"))
    stock = reconciliation._stock(spark, sf).withColumnRenamed("l_partkey", "item")
    return _Published(spark, order_lines=lines, invoices=invoices, cost_lines=planned.unionByName(booked), stock_counts=stock, receipts=receipts, issues=issues, job_sales=sales)


_TRACE = """
alloc AS (SELECT l_partkey, demand_id, supply_id, allocated FROM (""" + ORACLES["fifo_deadline"] + """) AS x),
dem AS (SELECT l_partkey AS p, l_orderkey * 100 + l_linenumber AS id, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS kg FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_partkey, l_orderkey, l_linenumber),
cov AS (SELECT l_partkey, demand_id, sum(allocated) AS got, bool_and(supply_id % 17 <> 0) AS heat, bool_and(supply_id % 11 <> 0) AS cert FROM alloc GROUP BY 1, 2),
tl AS (SELECT p % 50 AS job, kg, greatest(kg - coalesce(got, 0), 0) AS short, coalesce(heat, true) AS heat_ok, coalesce(cert, true) AS cert_ok, p % 5 = 0 AS unconfirmed, (p * 1000000000 + id) % 2 = 0 AS finished,
  (p * 1000000000 + id) % 3 <> 0 AS despatched, p % 4 IN (2, 3) AS exc2, p % 3 = 0 AS s355 FROM dem LEFT JOIN cov ON l_partkey = p AND demand_id = id)
"""
_TRACE += """,
tb AS (SELECT *, CASE WHEN NOT heat_ok THEN 'receipt: heat number missing' WHEN NOT cert_ok THEN 'receipt: mill certificate missing' WHEN short > 0.5 AND unconfirmed THEN 'issue: receipt grade unconfirmed' WHEN short > 0.5 THEN 'issue: no receipt on record' WHEN finished AND NOT despatched THEN 'despatch: no delivery note' ELSE 'complete' END AS break_at FROM tl),
tw AS (SELECT *, break_at NOT LIKE 'receipt:%' AND break_at NOT LIKE 'issue:%' AS whole, cert_ok AND short <= 0.5 AS shown FROM tb),
tx AS (SELECT *, CASE WHEN NOT despatched THEN NULL WHEN NOT exc2 AND NOT whole THEN 'a' WHEN s355 AND NOT shown THEN 'b' WHEN NOT whole THEN 'c' END AS exposure FROM tw),
tj AS (SELECT job, coalesce(c_mktsegment, '(no finance customer)') AS customer, coalesce(CAST(c_acctbal AS DECIMAL(12,2)), 0) AS sales, bool_or(exposure IN ('a', 'b')) AS exposed, bool_or(exposure = 'c') AS gap FROM tx LEFT JOIN (SELECT * FROM customer WHERE c_custkey < 40) ON c_custkey = job GROUP BY 1, 2, 3)
"""
_SHARE = "CAST(coalesce(round(100 * sum(CASE WHEN whole THEN kg ELSE 0 END) / nullif(sum(kg), 0), 2), 0) AS DOUBLE)"
_TONNES = "CAST(coalesce(round(sum(kg) / 1000, 3), 0) AS DOUBLE)"
_COUNT = "CAST(count(*) AS DOUBLE)"
_TRACED = [
    ("coverage", _SHARE, "tx"), ("coverage_exc3", _SHARE, "tx WHERE NOT exc2"), ("coverage_exc2", _SHARE, "tx WHERE exc2"), ("exposed_kg", _TONNES, "tx WHERE exposure IN ('a', 'b')"), ("exposed_kg_exc3", _TONNES, "tx WHERE exposure = 'a'"),
    ("exposed_kg_s355", _TONNES, "tx WHERE exposure = 'b'"), ("gap_kg", _TONNES, "tx WHERE exposure = 'c'"),
    *((f"break_{b.split(': ')[1].replace(' ', '_')}", _COUNT, f"tx WHERE break_at = '{b}'") for b in ("receipt: heat number missing", "receipt: mill certificate missing", "issue: receipt grade unconfirmed", "issue: no receipt on record", "despatch: no delivery note")),
    ("exposed_jobs", _COUNT, "tj WHERE exposed"), ("exposed_customers", "CAST(count(DISTINCT customer) AS DOUBLE)", "tj WHERE exposed"), ("exposed_sales", "CAST(coalesce(round(sum(sales), 2), 0) AS DOUBLE)", "tj WHERE exposed"), ("gap_jobs", _COUNT, "tj WHERE gap"),
    ("s355_receipts_no_31", _COUNT, "(SELECT DISTINCT l_partkey, l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F' AND l_partkey % 3 = 0 AND (l_orderkey * 100 + l_linenumber) % 11 = 0) AS r"),
]
_JOBS = [("gross_gap", "CAST(round(sum(abs(gap)), 2) AS DOUBLE)", "gapped"), ("net_gap", "CAST(round(sum(gap), 2) AS DOUBLE)", "gapped"), ("jobs_over", _COUNT, "gapped WHERE gap > 0"), ("jobs_under", _COUNT, "gapped WHERE gap < 0")]
_STOCK = [("gross_error", "CAST(round(sum(abs(counted - book)), 2) AS DOUBLE)", "s"), ("net_adjustment", "CAST(round(sum(counted - book), 2) AS DOUBLE)", "s"), ("lines", _COUNT, "s"), ("accurate_lines", _COUNT, "s WHERE abs(counted - book) <= book * 0.02")]


def _told(engine, with_, asked):
    return f"SELECT * FROM ({with_} " + " UNION ALL ".join(f"SELECT '{engine}' AS engine, '{k}' AS key, {v} AS value FROM {t}" for k, v, t in asked) + f") AS of_{engine}"


@query("stage_headlines", "SELECT 'three_way' AS engine, key, value FROM (" + ORACLES["three_way_headlines"] + ") AS h UNION ALL " + " UNION ALL ".join([
    _told("job_cost", reconciliation._COST, _JOBS), _told("stock", reconciliation._STOCK, _STOCK), _told("traceability", "WITH " + _TRACE.strip(), _TRACED)]))
def stage_headlines(spark, sf):
    """Every figure that the reconciliation stage publishes, each computed again from its rows before it was."""
    at = _reconciled(spark, sf)
    at.run(stages.run_reconcile, reconciliation.AS_OF, ("N",))
    return at.taken(at.read("headline").select("engine", "key", "value"))


@query("headline_rows", "WITH h AS (" + reconciliation._THREE.strip() + f" SELECT line_type, line_id, category, CAST(value_at_risk AS DOUBLE) AS value_at_risk, exception_date FROM whole WHERE {reconciliation._OLD}) SELECT * FROM h")
def headline_rows(spark, sf):
    """The rows behind one published figure, by the query that the figure itself carries."""
    at = _reconciled(spark, sf)
    at.run(stages.run_reconcile, reconciliation.AS_OF, ("N",))
    reader = publish.Reader(spark, at.root)
    sql = reader.query("SELECT rows_sql FROM headline WHERE engine = :engine AND key = :key", {"engine": "three_way", "key": "over_90_days"}).first()["rows_sql"]
    return at.taken(reader.query(sql).drop("_source_file", "_source_row").withColumn("value_at_risk", F.col("value_at_risk").cast("double")))


@query("headline_raw_lines", "WITH h AS (" + reconciliation._THREE.strip() + f""" SELECT line_type, line_id FROM whole WHERE {reconciliation._OLD}), received AS ({_RECEIVED}),
named AS (SELECT DISTINCT CASE line_type WHEN 'PO line' THEN 'orders.csv' ELSE 'invoices.csv' END AS _source_file, CAST(CASE line_type WHEN 'PO line' THEN CAST(line_id AS BIGINT) + 2 ELSE CAST(split_part(line_id, '-', 1) AS BIGINT) * 10 + CAST(split_part(line_id, '-', 2) AS BIGINT) END AS INT) AS _source_row FROM h)
SELECT r.* FROM received r JOIN named USING (_source_file, _source_row)""")
def headline_raw_lines(spark, sf):
    """The lines as received behind the exceptions of over 90 days."""
    received = spark.sql(_RECEIVED.replace("FROM orders", "FROM {orders}").replace("FROM lineitem", "FROM {lineitem}"), orders=read(spark, sf, "orders"), lineitem=read(spark, sf, "lineitem"))
    at = _reconciled(spark, sf)
    at.run(stages.run_reconcile, reconciliation.AS_OF, ("N",))
    publish.retain(spark, at.root, "three_way_lines", "headline")
    at.add("raw", raw_lines=received.sortWithinPartitions("_source_file", "_source_row"))
    return at.gone(stages.lines_behind(spark, at.root, "three_way", "over_90_days"))
