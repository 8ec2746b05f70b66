"""Reconciliations: orders against their lines as receipts and invoices, cost gaps, counts, and first-in first-out supply."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import allocation, reconcile
from ..operators.components import checkpointed
from .registry import query, read

AS_OF = "2001-06-01"
_M = "CAST({} AS DECIMAL(12,2))"


def three_way_lines(spark, sf):
    """Orders, those without lines too, with what their lines say was ordered, received (not returned) and invoiced (received, status F), nine days after."""
    line = read(spark, sf, "lineitem")
    money = lambda c: F.col(c).cast("decimal(12,2)")
    received, billed = F.col("l_returnflag") != "R", (F.col("l_returnflag") != "R") & (F.col("l_linestatus") == "F")
    sums = line.groupBy("l_orderkey").agg(
        F.sum(money("l_quantity")).alias("ordered"), F.sum(F.when(received, money("l_quantity"))).alias("received"), F.sum(F.when(received, money("l_extendedprice"))).alias("received_value"),
        F.sum(money("l_extendedprice")).alias("line_value"),
        F.sum(F.when(billed, (money("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)")) * (1 + F.col("l_tax").cast("decimal(4,2)"))).cast("decimal(18,6)"))).alias("invoiced"),
        F.max(F.when(received, F.col("l_shipdate").cast("date"))).alias("received_on"), F.max(F.when(billed, F.date_add(F.col("l_shipdate").cast("date"), 9))).alias("invoiced_on"),
    )
    joined = read(spark, sf, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(
        "o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("promised"), "received_on", "invoiced_on", F.coalesce("ordered", F.lit(0)).alias("ordered"), "received", "received_value", "invoiced",
        F.coalesce("line_value", money("o_totalprice")).alias("order_value"),
    )


_THREE = f"""
WITH sums AS (SELECT l_orderkey, sum({_M.format('l_quantity')}) AS ordered, sum({_M.format('l_quantity')}) FILTER (WHERE l_returnflag <> 'R') AS received,
sum({_M.format('l_extendedprice')}) FILTER (WHERE l_returnflag <> 'R') AS worth, sum({_M.format('l_extendedprice')}) AS line_value,
sum(CAST({_M.format('l_extendedprice')} * (1 - CAST(l_discount AS DECIMAL(4,2))) * (1 + CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(18,6))) FILTER (WHERE l_returnflag <> 'R' AND l_linestatus = 'F') AS invoiced,
max(CAST(l_shipdate AS DATE)) FILTER (WHERE l_returnflag <> 'R') AS received_on, max(CAST(l_shipdate AS DATE) + 9) FILTER (WHERE l_returnflag <> 'R' AND l_linestatus = 'F') AS invoiced_on FROM lineitem GROUP BY 1),
lines AS (SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS promised, received_on, invoiced_on, coalesce(ordered, 0) AS ordered, received, worth, invoiced, coalesce(line_value, {_M.format('o_totalprice')}) AS order_value,
CAST(received AS DOUBLE) AS r, CAST(coalesce(ordered, 0) AS DOUBLE) AS o, CAST(worth AS DOUBLE) AS w, CAST(invoiced AS DOUBLE) AS i FROM orders LEFT JOIN sums ON o_orderkey = l_orderkey),
judged AS (SELECT *, CASE WHEN received IS NULL THEN CASE WHEN promised + 5 > DATE '{AS_OF}' THEN 'not yet due' ELSE 'missing GRN' END
WHEN invoiced IS NULL THEN CASE WHEN received_on + 30 > DATE '{AS_OF}' THEN 'not yet due' ELSE 'missing invoice' END
WHEN abs(i - w) > w * 0.05::DOUBLE + greatest(1.0::DOUBLE, w * 0.05::DOUBLE) * 1e-9 THEN 'price variance'
WHEN abs(r - o) > o * 0.02::DOUBLE + greatest(1.0::DOUBLE, o * 0.02::DOUBLE) * 1e-9 THEN 'quantity variance' ELSE 'matched' END AS category FROM lines),
risked AS (SELECT *, CASE category WHEN 'missing GRN' THEN CAST(order_value AS DECIMAL(20,6)) WHEN 'missing invoice' THEN CAST(worth AS DECIMAL(20,6)) WHEN 'price variance' THEN CAST(abs(invoiced - worth) AS DECIMAL(20,6)) WHEN 'quantity variance' THEN CAST(abs(r - o) * w / r AS DECIMAL(20,6)) ELSE CAST(0 AS DECIMAL(20,6)) END AS value_at_risk,
CASE category WHEN 'missing GRN' THEN promised WHEN 'missing invoice' THEN received_on WHEN 'price variance' THEN invoiced_on WHEN 'quantity variance' THEN invoiced_on END AS exception_date FROM judged),
invoices AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS line_id, {_M.format('l_extendedprice')} AS amount, CAST(l_shipdate AS DATE) AS invoiced_on, CASE l_linenumber WHEN 7 THEN NULL WHEN 6 THEN l_orderkey + 100000000 ELSE l_orderkey END AS po_no, l_returnflag AS nominal FROM lineitem),
whole AS (SELECT 'PO line' AS line_type, CAST(o_orderkey AS VARCHAR) AS line_id, category, value_at_risk, exception_date FROM risked
UNION ALL SELECT 'invoice', line_id, 'invoice with no PO', CAST(amount AS DECIMAL(20,6)), invoiced_on FROM invoices v WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = po_no) AND nominal <> 'N')
"""


def matched_lines(spark, sf):
    return reconcile.three_way(three_way_lines(spark, sf), AS_OF)


@query("three_way_match", _THREE + "SELECT o_orderkey, category, CAST(ordered AS DOUBLE) AS ordered, CAST(received AS DOUBLE) AS received, CAST(invoiced AS DOUBLE) AS invoiced, CAST(value_at_risk AS DOUBLE) AS value_at_risk, exception_date FROM risked")
def three_way_match(spark, sf):
    doubles = [F.col(c).cast("double").alias(c) for c in ("ordered", "received", "invoiced", "value_at_risk")]
    return matched_lines(spark, sf).select("o_orderkey", "category", *doubles, "exception_date")


_DAY = "strftime({}, '%d/%m/%Y')"
_MONEY = "'£' || printf('%,.2f', round(CAST({} AS DOUBLE), 2))"


@query("three_way_reasons", _THREE + f"""
SELECT o_orderkey, category, CASE WHEN received IS NULL THEN CASE category WHEN 'not yet due' THEN 'promised ' || {_DAY.format("promised")} || '; not due for receipt until ' || {_DAY.format("promised + 5")} ELSE 'promised ' || {_DAY.format("promised")} || ', nothing received; ' || {_MONEY.format("order_value")} || ' committed' END
WHEN invoiced IS NULL THEN CASE category WHEN 'not yet due' THEN 'received ' || {_DAY.format("received_on")} || '; invoice not due until ' || {_DAY.format("received_on + 30")} ELSE 'received ' || {_DAY.format("received_on")} || ', not invoiced; ' || {_MONEY.format("w")} || ' unaccrued' END
WHEN category = 'price variance' THEN 'invoiced ' || {_MONEY.format("i")} || ' against ' || {_MONEY.format("w")} || ' expected; tolerance ' || {_MONEY.format("floor(w * 0.05::DOUBLE * 100 + 0.5) / 100")}
WHEN category = 'quantity variance' THEN 'ordered ' || printf('%.0f', o) || ', received ' || printf('%.0f', r) || ' (' || printf('%+.1f', floor((r - o) * 100 / o * 10 + 0.5) / 10) || '%); tolerance 2%'
ELSE 'received ' || printf('%.0f', r) || ' of ' || printf('%.0f', o) || '; invoice within ' || {_MONEY.format("floor(w * 0.05::DOUBLE * 100 + 0.5) / 100")} END AS reason FROM risked""")
def three_way_reasons(spark, sf):
    return matched_lines(spark, sf).select("o_orderkey", "category", "reason")


def whole_match(spark, sf):
    """Order lines and invoices that no order accounts for."""
    invoices = _invoices(spark, sf)
    lost = reconcile.without_order(invoices, read(spark, sf, "orders").select(F.col("o_orderkey").alias("po_no")), ("N",))
    return reconcile.both_sides(matched_lines(spark, sf), lost.withColumn("line_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")), "o_orderkey", "line_id")


@query("three_way_both_sides", _THREE + "SELECT line_type, line_id, category, CAST(value_at_risk AS DOUBLE) AS value_at_risk, exception_date FROM whole")
def three_way_both_sides(spark, sf):
    return whole_match(spark, sf).withColumn("value_at_risk", F.col("value_at_risk").cast("double"))


@query("three_way_summary", _THREE + ", c AS (SELECT * FROM (VALUES ('matched'), ('quantity variance'), ('price variance'), ('missing GRN'), ('missing invoice'), ('invoice with no PO'), ('not yet due')) AS v(category)) SELECT c.category, count(r.category) AS n_rows, CAST(round(coalesce(sum(value_at_risk), 0), 2) AS DOUBLE) AS total FROM c LEFT JOIN whole r ON c.category = r.category GROUP BY 1")
def three_way_summary(spark, sf):
    return reconcile.summary(whole_match(spark, sf), "category", reconcile.CATEGORIES, "value_at_risk").withColumn("total", F.round("total", 2))


_BUCKET = "CASE WHEN {0} <= 30 THEN '0-30 days' WHEN {0} <= 60 THEN '31-60 days' WHEN {0} <= 90 THEN '61-90 days' WHEN {0} <= 180 THEN '91-180 days' ELSE 'over 180 days' END"


@query("three_way_ageing", _THREE + f"SELECT category, {_BUCKET.format(f"""date_diff('day', exception_date, DATE '{AS_OF}')""")} AS bucket, count(*) AS n_rows, CAST(round(sum(value_at_risk), 2) AS DOUBLE) AS total FROM whole WHERE exception_date IS NOT NULL GROUP BY 1, 2")
def three_way_ageing(spark, sf):
    age = F.datediff(F.lit(AS_OF).cast("date"), "exception_date")
    return whole_match(spark, sf).filter("exception_date is not null").groupBy("category", reconcile.age_bucket(age).alias("bucket")).agg(F.count("*").alias("n_rows"), F.round(F.sum("value_at_risk"), 2).cast("double").alias("total"))


@query("exception_rate", _THREE + "SELECT category, count(*) AS n_lines, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share FROM whole WHERE line_type = 'PO line' AND exception_date IS NOT NULL GROUP BY category")
def exception_rate(spark, sf):
    counted = whole_match(spark, sf).filter("line_type = 'PO line' AND exception_date IS NOT NULL").groupBy("category").agg(F.count("*").alias("n_lines"))
    every = counted.agg(F.sum("n_lines").alias("n"))
    return counted.crossJoin(F.broadcast(every)).select("category", "n_lines", (F.col("n_lines").cast("double") / F.col("n")).alias("share"))


_COST = f"""
WITH detail AS (SELECT p_brand AS job, 'planned' AS side, CASE WHEN p_size % 2 = 0 THEN 'material' ELSE 'labour' END AS component, {_M.format('p_retailprice')} * 10 AS amount FROM part
UNION ALL SELECT p_brand, 'actual', CASE WHEN p_size % 2 = 0 THEN 'material' ELSE 'labour' END, {_M.format('l_extendedprice')} FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F'),
wide AS (SELECT job, coalesce(sum(amount) FILTER (WHERE side = 'planned' AND component = 'material'), 0) AS planned_material, coalesce(sum(amount) FILTER (WHERE side = 'planned' AND component = 'labour'), 0) AS planned_labour,
coalesce(sum(amount) FILTER (WHERE side = 'actual' AND component = 'material'), 0) AS actual_material, coalesce(sum(amount) FILTER (WHERE side = 'actual' AND component = 'labour'), 0) AS actual_labour FROM detail GROUP BY 1),
gapped AS (SELECT *, actual_material - planned_material AS gap_material, actual_labour - planned_labour AS gap_labour, actual_material - planned_material + actual_labour - planned_labour AS gap FROM wide)
"""
_D = "CAST({0} AS DOUBLE) AS {0}"
_WIDE = ("planned_material", "planned_labour", "actual_material", "actual_labour", "gap_material", "gap_labour", "gap")


def cost_gaps(spark, sf):
    part = read(spark, sf, "part")
    kind = F.when(F.col("p_size") % 2 == 0, "material").otherwise("labour")
    planned = part.select(F.col("p_brand").alias("job"), F.lit("planned").alias("side"), kind.alias("component"), (F.col("p_retailprice").cast("decimal(12,2)") * 10).alias("amount"))
    booked = read(spark, sf, "lineitem").filter("l_linestatus = 'F'").join(part, F.col("l_partkey") == F.col("p_partkey"))
    actual = booked.select(F.col("p_brand").alias("job"), F.lit("actual").alias("side"), kind.alias("component"), F.col("l_extendedprice").cast("decimal(12,2)").alias("amount"))
    return reconcile.gaps(planned.unionByName(actual), ["job"], "side", ("planned", "actual"), "component", ("material", "labour"), "amount")


@query("job_cost_pivot", _COST + f"SELECT job, {', '.join(_D.format(c) for c in _WIDE)}, CAST(gap AS DOUBLE) / nullif(CAST(planned_material + planned_labour AS DOUBLE), 0) AS gap_share FROM gapped")
def job_cost_pivot(spark, sf):
    return cost_gaps(spark, sf).select("job", *(F.col(c).cast("double").alias(c) for c in _WIDE), "gap_share")


@query("misallocation", _COST + "SELECT CAST(sum(abs(gap)) AS DOUBLE) AS gross, CAST(abs(sum(gap)) AS DOUBLE) AS net, CAST(sum(abs(gap)) - abs(sum(gap)) AS DOUBLE) AS misallocated FROM gapped")
def misallocation(spark, sf):
    gross, net = F.sum(F.abs("gap")), F.abs(F.sum("gap"))
    return cost_gaps(spark, sf).agg(gross.cast("double").alias("gross"), net.cast("double").alias("net"), (gross - net).cast("double").alias("misallocated"))


_STOCK = f"WITH s AS (SELECT l_partkey, l_returnflag AS site, sum({_M.format('l_quantity')}) AS book, sum(CASE WHEN l_linenumber % 5 = 0 THEN {_M.format('l_quantity')} * 0.9 ELSE {_M.format('l_quantity')} END) AS counted FROM lineitem GROUP BY 1, 2)"


def _stock(spark, sf):
    q = F.col("l_quantity").cast("decimal(12,2)")
    return read(spark, sf, "lineitem").groupBy("l_partkey", F.col("l_returnflag").alias("site")).agg(F.sum(q).alias("book"), F.sum(F.when(F.col("l_linenumber") % 5 == 0, q * F.lit(0.9).cast("decimal(2,1)")).otherwise(q)).alias("counted"))


@query("stock_accuracy", _STOCK + " SELECT site, count(*) AS n_lines, count(*) FILTER (WHERE abs(counted - book) <= book * 0.02) AS n_accurate, CAST(sum(abs(counted - book)) AS DOUBLE) AS gross_error, CAST(sum(counted - book) AS DOUBLE) AS net_adjustment, CAST(count(*) FILTER (WHERE abs(counted - book) <= book * 0.02) AS DOUBLE) / count(*) >= 0.95 AS meets_target FROM s GROUP BY 1")
def stock_accuracy(spark, sf):
    accurate = F.count_if(F.abs(F.col("counted") - F.col("book")) <= F.col("book") * F.lit(0.02).cast("decimal(3,2)"))
    gap = F.col("counted") - F.col("book")
    return _stock(spark, sf).groupBy("site").agg(F.count("*").alias("n_lines"), accurate.alias("n_accurate"), F.sum(F.abs(gap)).cast("double").alias("gross_error"), F.sum(gap).cast("double").alias("net_adjustment"), (accurate / F.count("*") >= 0.95).alias("meets_target"))


@query("stock_offenders", _STOCK + " SELECT row_number() OVER (ORDER BY abs(counted - book) DESC, l_partkey, site) AS place, l_partkey, site, CAST(counted - book AS DOUBLE) AS difference FROM s ORDER BY 1 LIMIT 20")
def stock_offenders(spark, sf):


    gap = F.col("counted") - F.col("book")
    top = _stock(spark, sf).select("l_partkey", "site", gap.alias("gap")).orderBy(F.abs("gap").desc(), "l_partkey", "site").limit(20)
    return top.select(F.row_number().over(Window.orderBy(F.abs("gap").desc(), "l_partkey", "site")).alias("place"), "l_partkey", "site", F.col("gap").cast("double").alias("difference"))


_ID = "l_orderkey * 100 + l_linenumber"


def _sides(spark, sf):
    """Per part: status F lines supply, status O lines demand, each line number of an order once."""
    lines = read(spark, sf, "lineitem").groupBy("l_partkey", "l_linestatus", "l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("at"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    side = lambda s, n: lines.filter(F.col("l_linestatus") == s).select("l_partkey", F.expr(_ID).cast("long").alias(f"{n}_id"), "at", "quantity")
    return side("F", "supply"), side("O", "demand")


@query("fifo_allocation", f"""
WITH lines AS (SELECT l_partkey, l_linestatus, CAST({_ID} AS BIGINT) AS id, min(l_shipdate) AS t, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY l_partkey, l_linestatus, l_orderkey, l_linenumber),
s AS (SELECT l_partkey, id, q, sum(q) OVER (PARTITION BY l_partkey ORDER BY t, id) AS upto FROM lines WHERE l_linestatus = 'F' AND q > 0), d AS (SELECT l_partkey, id, q, sum(q) OVER (PARTITION BY l_partkey ORDER BY t, id) AS upto FROM lines WHERE l_linestatus = 'O' AND q > 0)
SELECT s.l_partkey, s.id AS supply_id, d.id AS demand_id, CAST(least(s.upto, d.upto) - greatest(s.upto - s.q, d.upto - d.q) AS BIGINT) AS allocated FROM s JOIN d ON s.l_partkey = d.l_partkey WHERE greatest(s.upto - s.q, d.upto - d.q) < least(s.upto, d.upto)""")
def fifo_allocation(spark, sf):
    supply, demand = _sides(spark, sf)
    return allocation.fifo(supply, demand, "l_partkey", ["at", "supply_id"], ["at", "demand_id"])


@query("fifo_deadline", f"""
WITH lines AS (SELECT l_partkey, l_linestatus, CAST({_ID} AS BIGINT) AS id, min(l_shipdate) AS t, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY l_partkey, l_linestatus, l_orderkey, l_linenumber),
s AS (SELECT l_partkey, id, t, q, sum(q) OVER (PARTITION BY l_partkey ORDER BY t, id) AS upto FROM lines WHERE l_linestatus = 'F' AND q > 0),
d AS (SELECT l_partkey, id, t, q, sum(q) OVER (PARTITION BY l_partkey ORDER BY t, id) AS wanted FROM lines WHERE l_linestatus = 'O' AND q > 0),
came AS (SELECT d.l_partkey, d.id, coalesce(sum(s.q), 0) AS supplied FROM d LEFT JOIN s ON s.l_partkey = d.l_partkey AND s.t <= d.t + INTERVAL 30 DAYS GROUP BY 1, 2),
taken AS (SELECT d.*, wanted + least(0, min(supplied - wanted) OVER (PARTITION BY d.l_partkey ORDER BY t, d.id)) AS upto FROM d JOIN came USING (l_partkey, id)),
cut AS (SELECT *, lag(upto, 1, 0) OVER (PARTITION BY l_partkey ORDER BY t, id) AS since FROM taken)
SELECT s.l_partkey, s.id AS supply_id, d.id AS demand_id, CAST(least(s.upto, d.upto) - greatest(s.upto - s.q, d.since) AS DOUBLE) AS allocated FROM s JOIN cut d ON s.l_partkey = d.l_partkey WHERE greatest(s.upto - s.q, d.since) < least(s.upto, d.upto)""")
def fifo_deadline(spark, sf):
    supply, demand = _sides(spark, sf)
    return allocation.fifo_with_deadline(supply, demand.withColumn("deadline", F.col("at") + F.expr("INTERVAL 30 DAYS")), "l_partkey")


_OLD = f"exception_date IS NOT NULL AND date_diff('day', exception_date, DATE '{AS_OF}') > 90"
_HEADS = " UNION ALL ".join(
    [f"SELECT 'value_at_risk' AS key, CAST(round(sum(value_at_risk), 2) AS DOUBLE) AS value FROM whole WHERE exception_date IS NOT NULL", f"SELECT 'over_90_days', CAST(count(*) AS DOUBLE) FROM whole WHERE {_OLD}"]
    + [f"SELECT '{c.replace(' ', '_')}_lines', CAST(count(*) AS DOUBLE) FROM whole WHERE category = '{c}'" for c in reconcile.CATEGORIES]
    + [f"SELECT '{c.replace(' ', '_')}_value', CAST(round(coalesce(sum(value_at_risk), 0), 2) AS DOUBLE) FROM whole WHERE category = '{c}'" for c in reconcile.CATEGORIES if c not in ("matched", "not yet due")]
)


@query("three_way_headlines", _THREE + _HEADS)
def three_way_headlines(spark, sf):
    """The 14 figures of the match, each verified against the rows that were published, read again."""
    published = checkpointed(whole_match(spark, sf))
    published.createOrReplaceTempView("three_way_lines")
    headlines = reconcile.exception_headlines("three_way_lines", published, AS_OF)
    reconcile.verify(spark, headlines)
    return spark.createDataFrame([(h.key, float(h.value)) for h in headlines], "key string, value double")


def _invoices(spark, sf):
    po = F.when(F.col("l_linenumber") == 6, F.col("l_orderkey") + 100000000).when(F.col("l_linenumber") != 7, F.col("l_orderkey"))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", po.alias("po_no"), F.col("l_returnflag").alias("nominal"), F.col("l_extendedprice").cast("decimal(12,2)").alias("amount"), F.col("l_shipdate").cast("date").alias("invoiced_on"))


@query("invoices_without_order", """
SELECT l_orderkey, l_linenumber, l_partkey, nominal, category, amount AS value_at_risk, exception_date FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS nominal, 'invoice with no PO' AS category, CAST(l_extendedprice AS DECIMAL(12,2)) AS amount, CAST(l_shipdate AS DATE) AS exception_date,
CASE l_linenumber WHEN 7 THEN NULL WHEN 6 THEN l_orderkey + 100000000 ELSE l_orderkey END AS po_no FROM lineitem) i WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = po_no) AND nominal <> 'N'""")
def invoices_without_order(spark, sf):
    invoices = _invoices(spark, sf)
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").alias("po_no"))
    return reconcile.without_order(invoices, orders, ("N",)).select("l_orderkey", "l_linenumber", "l_partkey", "nominal", "category", "value_at_risk", "exception_date")


_EXPLAINED = """
WITH l AS (SELECT o_custkey AS job, l_suppkey AS item, l_linestatus AS side, CAST(l_extendedprice AS DECIMAL(12,2)) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT job, item, coalesce(sum(v) FILTER (WHERE side = 'F'), 0) AS planned, coalesce(sum(v) FILTER (WHERE side = 'O'), 0) AS actual FROM l WHERE side IN ('F', 'O') GROUP BY 1, 2),
gaps AS (SELECT *, actual - planned AS gap FROM g)
"""


def _explained(spark, sf):
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("job"))
    lines = read(spark, sf, "lineitem").join(orders, "l_orderkey").select("job", F.col("l_suppkey").alias("item"), "l_linestatus", F.col("l_extendedprice").cast("decimal(12,2)").alias("v"))
    return reconcile.explained(lines.filter("l_linestatus = 'F'"), lines.filter("l_linestatus = 'O'"), ["job", "item"], "v")


@query("job_cost_explained", _EXPLAINED + "SELECT job, item, CAST(planned AS DOUBLE) AS planned, CAST(actual AS DOUBLE) AS actual, CAST(gap AS DOUBLE) AS gap FROM gaps")
def job_cost_explained(spark, sf):
    return _explained(spark, sf).select("job", "item", *(F.col(c).cast("double").alias(c) for c in ("planned", "actual", "gap")))


@query("job_cost_extremes", _EXPLAINED + """
SELECT job, CAST(sum(gap) AS DOUBLE) AS gap, CAST(sum(abs(gap)) AS DOUBLE) AS gross, arg_min(item, (-gap, item)) FILTER (WHERE gap > 0) AS most_over, CAST(max(gap) FILTER (WHERE gap > 0) AS DOUBLE) AS over,
  arg_min(item, (gap, item)) FILTER (WHERE gap < 0) AS most_under, CAST(min(gap) FILTER (WHERE gap < 0) AS DOUBLE) AS under FROM gaps GROUP BY job""")
def job_cost_extremes(spark, sf):
    found = reconcile.extremes(_explained(spark, sf), "job", "item")
    return found.select("job", "most_over", "most_under", *(F.col(c).cast("double").alias(c) for c in ("gap", "gross", "over", "under")))
