"""Job costs over orders as works orders, lines as bills of material and purchases, and events as bookings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import job_cost, reconcile
from ..operators.components import checkpointed
from .registry import query, read

RATE = 40.0
#: SQL that both engines read.
_MASS = "SELECT p_brand AS material, CAST(1 + MAX(p_partkey) % 7 AS DOUBLE) AS mass, CAST(12 + 12 * (MAX(p_partkey) % 7) AS DOUBLE) AS kg_per_ea FROM part GROUP BY p_brand"
_PURCHASES = "SELECT p_brand AS material, CAST(l_quantity AS DECIMAL(12,2)) AS qty, CASE l_linenumber % 3 WHEN 0 THEN 'KG' WHEN 1 THEN 'M' ELSE 'EA' END AS uom, CAST(l_extendedprice AS DECIMAL(12,2)) AS value FROM lineitem JOIN part ON l_partkey = p_partkey"
_BOM = "SELECT l_orderkey AS order_no, p_brand AS material, CAST(l_quantity AS DECIMAL(12,2)) AS qty, CASE l_linenumber % 2 WHEN 0 THEN 'KG' ELSE 'M' END AS uom FROM lineitem JOIN part ON l_partkey = p_partkey"
_ORDERS = "SELECT o_orderkey AS order_no, o_custkey AS job, CASE o_orderstatus WHEN 'P' THEN 'CANCELLED' ELSE 'OPEN' END AS status, CAST(o_orderkey % 40 AS DOUBLE) AS planned_hours FROM orders"
_FINANCE = "SELECT CASE WHEN o_orderkey % 23 <> 0 THEN o_custkey END AS job, CAST(o_orderkey % 100 AS {text}) AS code, CASE o_orderkey % 4 WHEN 0 THEN 'labour' WHEN 1 THEN 'subcontract' WHEN 2 THEN 'material' ELSE 'plant' END AS cost_type, CAST(o_totalprice AS DECIMAL(12,2)) AS amount FROM orders"
_BOOKINGS = "SELECT event_id * 2 AS order_no, CAST(1 + event_id % 9 AS DOUBLE) AS hours FROM events"
_INVOICED = "SELECT o_custkey AS job, p_brand AS material, CAST(l_extendedprice AS DECIMAL(12,2)) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'N'"

_M = "CAST({} AS DECIMAL(18,2))"
_COSTS = f"""
WITH mass AS ({_MASS}), purchases AS ({_PURCHASES}), bom AS ({_BOM}), wo AS ({_ORDERS}), fin AS ({_FINANCE.format(text="VARCHAR")}), booked AS ({_BOOKINGS}), invoiced AS ({_INVOICED}),
units AS (SELECT p.material, uom, CAST(sum(qty) AS DOUBLE) AS qty, sum(value) AS value, any_value(mass) AS mass, any_value(kg_per_ea) AS each FROM purchases p JOIN mass m ON m.material = p.material GROUP BY 1, 2),
paid AS (SELECT material, coalesce(sum(qty) FILTER (WHERE uom = 'KG'), 0.0::DOUBLE) + coalesce(sum(qty * mass) FILTER (WHERE uom = 'M'), 0.0::DOUBLE) + coalesce(sum(qty * each) FILTER (WHERE uom = 'EA'), 0.0::DOUBLE) AS kg, CAST(sum(value) AS DOUBLE) AS value FROM units GROUP BY 1),
price AS (SELECT material, value / nullif(kg, 0) AS price_per_kg FROM paid),
detail AS (SELECT CAST(w.job AS VARCHAR) AS job, 'mrp' AS view, 'material' AS component, b.material, NULL::DOUBLE AS hours, {_M.format("CAST(CASE uom WHEN 'KG' THEN qty ELSE qty * mass END AS DOUBLE) * price_per_kg")} AS amount, true AS in_mrp FROM bom b JOIN wo w USING (order_no) JOIN mass m ON m.material = b.material LEFT JOIN price p ON p.material = b.material WHERE status <> 'CANCELLED'
UNION ALL SELECT CAST(job AS VARCHAR), 'mrp', 'labour (planned)', NULL, planned_hours, {_M.format(f"planned_hours * {RATE}::DOUBLE")}, true FROM wo WHERE status <> 'CANCELLED'
UNION ALL SELECT coalesce(CAST(job AS VARCHAR), 'finance ' || code), 'finance', cost_type, NULL, NULL, amount, job IS NOT NULL FROM fin
UNION ALL SELECT CAST(job AS VARCHAR), 'ops', 'labour', NULL, hours, {_M.format(f"hours * {RATE}::DOUBLE")}, true FROM booked JOIN wo USING (order_no)),
sums AS (SELECT job, {", ".join(f"coalesce(sum(amount) FILTER (WHERE view = '{v}' AND component = '{c}'), 0) AS {name}" for (v, c), name in job_cost.SUMS.items())}, bool_and(in_mrp) AS in_mrp, CAST(coalesce(sum({_M.format("hours")}) FILTER (WHERE view = 'ops'), 0) AS DOUBLE) AS ops_hours, CAST(coalesce(sum({_M.format("hours")}) FILTER (WHERE component = 'labour (planned)'), 0) AS DOUBLE) AS planned_hours FROM detail GROUP BY 1),
gapped AS (SELECT *, finance_material - mrp_material AS material_gap, finance_labour - ops_labour AS labour_gap, mrp_material + ops_labour AS reference_cost, finance_material - mrp_material + finance_labour - ops_labour AS unexplained_gap FROM sums),
sides AS (SELECT coalesce(i.job, v.job) AS job, coalesce(i.item, v.item) AS item, coalesce(v.a, 0) - coalesce(i.a, 0) AS gap FROM (SELECT job, material AS item, sum(amount) AS a FROM detail WHERE view = 'mrp' AND component = 'material' GROUP BY 1, 2) i FULL JOIN (SELECT CAST(job AS VARCHAR) AS job, material AS item, sum(amount) AS a FROM invoiced GROUP BY 1, 2) v ON v.job = i.job AND v.item = i.item),
most AS (SELECT job, arg_min(item, (-gap, item)) FILTER (WHERE gap > 0) AS most_over, max(gap) FILTER (WHERE gap > 0) AS over, arg_min(item, (gap, item)) FILTER (WHERE gap < 0) AS most_under, min(gap) FILTER (WHERE gap < 0) AS under FROM sides GROUP BY 1),
ranked AS (SELECT g.*, m.* EXCLUDE (job), CAST(unexplained_gap AS DOUBLE) / nullif(CAST(reference_cost AS DOUBLE), 0) AS gap_pct, CAST(labour_gap AS DOUBLE) / nullif(CAST(ops_labour AS DOUBLE), 0) AS labour_gap_pct, (ops_hours - planned_hours) / nullif(planned_hours, 0) AS hours_vs_plan_pct, CAST(row_number() OVER (ORDER BY abs(unexplained_gap) DESC, g.job) AS INT) AS rank FROM gapped g LEFT JOIN most m ON m.job = g.job)
"""
_P = "'£' || printf('%,.0f', floor(CAST({} AS DOUBLE) + 0.5))"
_WORDS = f"""CASE WHEN NOT in_mrp THEN 'finance job code with no planned job: none of this cost has an operational record' ELSE coalesce(nullif(concat_ws('; ',
CASE WHEN abs(material_gap) >= 1 THEN 'finance material ' || {_P.format("finance_material")} || ' vs planned material ' || {_P.format("mrp_material")} || coalesce('; charged ' || {_P.format("over")} || ' more ' || most_over || ' than issued', '') || coalesce('; issued ' || {_P.format("-under")} || ' of ' || most_under || ' charged elsewhere', '') END,
CASE WHEN abs(labour_gap) >= 1 THEN 'finance labour ' || {_P.format("finance_labour")} || ' vs ' || printf('%,.1f', ops_hours) || ' booked hours (' || {_P.format("ops_labour")} || ')' END), ''), 'reconciles') END AS explanation"""
_MONEY = (*job_cost.SUMS.values(), "material_gap", "labour_gap", "reference_cost", "unexplained_gap")


def _parts(spark, sf):
    tables = {t: read(spark, sf, t) for t in ("part", "lineitem", "orders", "events")}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    masses, purchases, bom, orders, finance, bookings, invoiced = (spark.sql(q.format(text="STRING")) for q in (_MASS, _PURCHASES, _BOM, _ORDERS, _FINANCE, _BOOKINGS, _INVOICED))
    lines = checkpointed(job_cost.detail(bom, orders, finance, bookings, job_cost.prices(purchases, masses), masses, RATE))
    job_cost.assert_priced(lines)
    return lines, job_cost.jobs(lines, job_cost.materials(lines, invoiced)), job_cost.unallocated(bookings, orders)


@query("job_cost_jobs", _COSTS + f"SELECT rank, job, in_mrp, ops_hours, planned_hours, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _MONEY)}, gap_pct, labour_gap_pct, hours_vs_plan_pct, {_WORDS} FROM ranked")
def job_cost_jobs(spark, sf):
    return _parts(spark, sf)[1].withColumns({c: F.col(c).cast("double") for c in _MONEY})


_R = "CAST(coalesce(round({}, 2), 0) AS DOUBLE)"
_ASKED = [
    ("gross_gap", _R.format("sum(abs(unexplained_gap))"), "ranked"), ("net_gap", _R.format("sum(unexplained_gap)"), "ranked"), ("labour_gap_gross", _R.format("sum(abs(labour_gap))"), "ranked"), ("material_gap_gross", _R.format("sum(abs(material_gap))"), "ranked WHERE in_mrp"),
    ("material_misallocated", _R.format("sum(abs(material_gap)) - abs(sum(material_gap))"), "ranked WHERE in_mrp"), ("jobs_over_10pct", "CAST(count(*) AS DOUBLE)", "ranked WHERE abs(gap_pct) > 0.10::DOUBLE"), ("top_job_gap", _R.format("sum(unexplained_gap)"), "ranked WHERE rank = 1"),
    ("finance_only_cost", _R.format("sum(amount)"), "detail WHERE NOT in_mrp"), *((f"total_{job_cost.SUMS[k]}", _R.format("sum(amount)"), f"detail WHERE view = '{k[0]}' AND component = '{k[1]}'") for k in (("mrp", "material"), ("finance", "material"), ("finance", "labour"), ("ops", "labour"))),
    ("unallocated_hours", _R.format("sum(hours)"), "booked WHERE order_no NOT IN (SELECT order_no FROM wo)"),
]


@query("job_cost_headlines", _COSTS + " UNION ALL ".join(f"SELECT '{k}' AS key, {v} AS value FROM {t}" for k, v, t in _ASKED))
def job_cost_headlines(spark, sf):
    """The figures of job costs, each computed again from the rows it names."""
    lines, ranked, lost = _parts(spark, sf)
    tables = {"job_cost": checkpointed(ranked), "job_cost_detail": lines, "unallocated_bookings": lost}
    found = job_cost.figures(spark, *tables.values())
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    reconcile.verify(spark, found)
    return spark.createDataFrame([(h.key, float(h.value)) for h in found], "key string, value double")
