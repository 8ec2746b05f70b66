"""Traceability over order lines: what the first-in first-out allocation covers, where chains break, what that exposes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import allocation, traceability
from .registry import ORACLES, query
from .reconciliation import _sides

_LINE = "l_partkey * 1000000000 + {}"

_TRACED = f"""
WITH alloc AS (SELECT CAST({_LINE.format("demand_id")} AS BIGINT) AS line_id, CAST({_LINE.format("supply_id")} AS BIGINT) AS receipt_id, allocated FROM ({ORACLES["fifo_allocation"]})),
dem AS (SELECT CAST(l_partkey * 1000000000 + l_orderkey * 100 + l_linenumber AS BIGINT) AS line_id, l_partkey, strftime(min(l_shipdate), '%Y-%m') AS month, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS kg FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_partkey, l_orderkey, l_linenumber),
cov AS (SELECT line_id, CAST(sum(allocated) AS DOUBLE) AS got, bool_and(receipt_id % 17 <> 0) AS heat, bool_and(receipt_id % 11 <> 0) AS cert, string_agg(CAST(receipt_id AS VARCHAR), ', ' ORDER BY CAST(receipt_id AS VARCHAR)) FILTER (WHERE receipt_id % 17 = 0) AS lacks FROM alloc GROUP BY line_id),
lines AS (SELECT line_id, kg, month, CASE WHEN l_partkey % 2 = 0 THEN 'N' ELSE 'S' END AS site, coalesce(got, 0) AS kg_allocated, kg - coalesce(got, 0) AS kg_short, coalesce(heat, true) AS heat_ok, coalesce(cert, true) AS cert_ok, coalesce(lacks, '') AS missing_heat,
  l_partkey % 5 = 0 AS unconfirmed, line_id % 2 = 0 AS finished, line_id % 3 <> 0 AS despatched, CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'EXC3' ELSE 'EXC2' END AS execution_class, l_partkey % 3 = 0 AS s355 FROM dem LEFT JOIN cov USING (line_id)),
broken AS (SELECT *, CASE WHEN NOT heat_ok THEN 'receipt: heat number missing' WHEN NOT cert_ok THEN 'receipt: mill certificate missing' WHEN kg_short > 0.5 AND unconfirmed THEN 'issue: receipt grade unconfirmed'
  WHEN kg_short > 0.5 THEN 'issue: no receipt on record' WHEN finished AND NOT despatched THEN 'despatch: no delivery note' ELSE 'complete' END AS break_at FROM lines),
judged AS (SELECT *, break_at NOT LIKE 'receipt:%' AND break_at NOT LIKE 'issue:%' AS whole, CASE WHEN s355 THEN cert_ok AND kg_short <= 0.5 END AS document_31_shown FROM broken),
traced AS (SELECT *, CASE WHEN NOT despatched THEN NULL WHEN execution_class IS DISTINCT FROM 'EXC2' AND NOT whole THEN 'EN 1090: EXC3 chain incomplete' WHEN s355 AND NOT document_31_shown THEN 'EN 1090: S355 with no 3.1 document shown' WHEN NOT whole THEN 'good practice: EXC2 chain incomplete' END AS exposure FROM judged)
"""


def _traced(spark, sf):
    supply, demand = _sides(spark, sf)
    met = allocation.fifo(supply, demand, "l_partkey", ["at", "supply_id"], ["at", "demand_id"])
    alloc = met.select(F.expr(_LINE.format("demand_id")).alias("line_id"), F.expr(_LINE.format("supply_id")).alias("receipt_id"), F.col("allocated").alias("kg"))
    papers = lambda every: F.when(F.col("receipt_id") % every != 0, "on file")
    receipts = supply.select(F.expr(_LINE.format("supply_id")).alias("receipt_id")).select("receipt_id", papers(17).alias("heat_number"), papers(11).alias("mill_cert_ref"))
    part = F.col("l_partkey")
    lines = demand.select(F.expr(_LINE.format("demand_id")).alias("line_id"), "l_partkey", "at", F.col("quantity").cast("double").alias("kg")).select(
        "line_id", "kg", F.date_format("at", "yyyy-MM").alias("month"), F.when(part % 2 == 0, "N").otherwise("S").alias("site"), (part % 5 == 0).alias("unconfirmed"), (F.col("line_id") % 2 == 0).alias("finished"), (F.col("line_id") % 3 != 0).alias("despatched"),
        F.when(part % 4 == 1, "EXC3").when(part % 4 != 0, "EXC2").alias("execution_class"), F.when(part % 3 == 0, "S355J2").otherwise("S275JR").alias("grade"),
    )
    return traceability.traced(traceability.coverage(lines, alloc, receipts))


@query("trace_lines", _TRACED + "SELECT line_id, kg, kg_allocated, kg_short, missing_heat, break_at, document_31_shown, exposure FROM traced")
def trace_lines(spark, sf):
    return _traced(spark, sf).select("line_id", "kg", "kg_allocated", "kg_short", "missing_heat", "break_at", "document_31_shown", "exposure")


@query("trace_rollup", _TRACED + """
SELECT execution_class, count(*) AS n_lines, sum(kg) AS kg, sum(CASE WHEN whole THEN kg ELSE 0 END) AS kg_traced, sum(CASE WHEN whole THEN kg ELSE 0 END) / sum(kg) AS coverage, count(*) FILTER (WHERE NOT whole) AS broken_lines,
  count(*) FILTER (WHERE despatched) AS despatched_lines, count(*) FILTER (WHERE exposure LIKE 'EN%') AS exposed_lines, sum(CASE WHEN exposure LIKE 'EN%' THEN kg ELSE 0 END) AS exposed_kg,
  count(*) FILTER (WHERE exposure LIKE 'good%') AS gap_lines, sum(CASE WHEN exposure LIKE 'good%' THEN kg ELSE 0 END) AS gap_kg FROM traced GROUP BY execution_class""")
def trace_rollup(spark, sf):
    return traceability.rollup(_traced(spark, sf), ["execution_class"])


@query("trace_breaks", _TRACED + "SELECT break_at, count(*) AS n_lines, sum(kg) AS kg, count(*) FILTER (WHERE despatched AND NOT whole) AS exposed_lines FROM traced GROUP BY break_at")
def trace_breaks(spark, sf):
    exposed = F.count_if(F.col("despatched") & ~F.col("material_chain_complete"))
    return _traced(spark, sf).groupBy("break_at").agg(F.count("*").alias("n_lines"), F.sum("kg").alias("kg"), exposed.alias("exposed_lines"))


_KG = "sum(CASE WHEN {} THEN kg ELSE 0 END)"
_NEEDED = "execution_class IS DISTINCT FROM 'EXC2'"


@query("traceability_coverage", _TRACED + f"""SELECT month, site, execution_class, count(*) AS n_lines, sum(kg) AS kg, {_KG.format("whole")} / sum(kg) AS coverage, {_KG.format(_NEEDED)} AS required_kg,
  {_KG.format("whole AND " + _NEEDED)} / nullif({_KG.format(_NEEDED)}, 0) AS required_coverage, {_KG.format("exposure LIKE 'EN%'")} AS exposed_kg FROM traced GROUP BY month, site, execution_class""")
def traceability_coverage(spark, sf):
    return traceability.coverage_by(_traced(spark, sf), ["month", "site", "execution_class"])
