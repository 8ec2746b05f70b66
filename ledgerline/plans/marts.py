"""KPI views and their scorecard."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conformance, joins, marts
from ..operators.reconcile import age_bucket
from .registry import query, read, views

AS_OF = "2001-06-01"


@query("weekly_capacity", "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, count(*) AS n_events, count(*) FILTER (WHERE value > 50) AS n_large, CAST(count(*) FILTER (WHERE value > 50) AS DOUBLE) / count(*) AS utilisation FROM events GROUP BY 1, 2")
def weekly_capacity(spark, sf):
    large = F.count_if(F.col("value") > 50)
    return read(spark, sf, "events").groupBy(F.date_trunc("week", "ts").cast("date").alias("week"), "event_type").agg(F.count("*").alias("n_events"), large.alias("n_large"), (large.cast("double") / F.count("*")).alias("utilisation"))


@query("wip_ageing", f"SELECT o_orderstatus, CASE WHEN d <= 30 THEN '0-30 days' WHEN d <= 60 THEN '31-60 days' WHEN d <= 90 THEN '61-90 days' WHEN d <= 180 THEN '91-180 days' ELSE 'over 180 days' END AS bucket, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS value FROM (SELECT *, date_diff('day', o_orderdate, TIMESTAMP '{AS_OF} 00:00:00') AS d FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1, 2")
def wip_ageing(spark, sf):
    age = F.datediff(F.lit(AS_OF).cast("date"), "o_orderdate")
    return read(spark, sf, "orders").filter("o_orderstatus <> 'F'").groupBy("o_orderstatus", age_bucket(age).alias("bucket")).agg(F.count("*").alias("n_orders"), F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double").alias("value"))


@query("cut_yield", "SELECT p_type, CAST(sum(pieces) AS BIGINT) AS pieces, CAST(sum(bars) AS BIGINT) AS bars, CAST(sum(pieces * mm) AS DOUBLE) / (sum(bars) * 12000) AS yield FROM (SELECT p_type, mm, pieces, CAST(ceil(CAST(pieces AS DOUBLE) / floor(12000.0 / mm)) AS BIGINT) AS bars FROM (SELECT p_type, p_size * 100 AS mm, 1 + p_partkey % 40 AS pieces FROM part)) GROUP BY 1")
def cut_yield(spark, sf):
    sized = read(spark, sf, "part").select("p_type", (F.col("p_size") * 100).alias("mm"), (1 + F.col("p_partkey") % 40).alias("pieces"))
    bars = F.ceil(F.col("pieces").cast("double") / F.floor(F.lit(12000.0) / F.col("mm")))
    return sized.withColumn("bars", bars).groupBy("p_type").agg(F.sum("pieces").alias("pieces"), F.sum("bars").alias("bars"), (F.sum(F.col("pieces") * F.col("mm")).cast("double") / (F.sum("bars") * 12000)).alias("yield"))


@query("otif_by_month", "SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (WHERE date_diff('day', o_orderdate, l_shipdate) <= 60) AS on_time, count(*) FILTER (WHERE l_returnflag <> 'R') AS in_full, CAST(count(*) FILTER (WHERE date_diff('day', o_orderdate, l_shipdate) <= 60 AND l_returnflag <> 'R') AS DOUBLE) / count(*) AS otif FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def otif_by_month(spark, sf):
    lines = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    on_time, in_full = F.datediff("l_shipdate", "o_orderdate") <= 60, F.col("l_returnflag") != "R"
    return lines.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.count_if(on_time).alias("on_time"), F.count_if(in_full).alias("in_full"), (F.count_if(on_time & in_full).cast("double") / F.count("*")).alias("otif"))


CAVEAT = "Counted over lines as recorded, so a line that was never entered is missing from both sides, and a date that was entered late makes a delivery look late although the goods left in time."
VIEWS = {
    "mart_lines": "SELECT l_orderkey, datediff(l_shipdate, o_orderdate) AS days, l_returnflag, CAST(l_extendedprice AS DECIMAL(12,2)) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "mart_returns": "SELECT sum(price) FILTER (WHERE l_returnflag = 'R') AS returned, sum(price) AS shipped FROM mart_lines",
}
KPIS = [
    marts.Kpi("KPI-01", "Shipped in time", "Production Controller", CAVEAT, "higher", "mart_lines", "100.0D * count_if(days <= 60) / count(*)", 95.0, views={"mart_lines": "One row for each line with the days from order to shipment."}),
    marts.Kpi("KPI-02", "Returned value", "Quality Manager", CAVEAT, "band", "mart_returns", "max(CAST(returned AS DOUBLE) / CAST(shipped AS DOUBLE))", None, 0.0, 0.4, {"mart_returns": "Value returned and shipped."}),
    marts.Kpi("KPI-03", "Lines", "Finance Manager", CAVEAT, "none", "mart_lines", "count(*)"),
]


@query("kpi_scorecard", """
WITH m AS (SELECT date_diff('day', o_orderdate, l_shipdate) AS days, l_returnflag, CAST(l_extendedprice AS DECIMAL(12,2)) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
v AS (SELECT 100.0::DOUBLE * count(*) FILTER (WHERE days <= 60) / count(*) AS a, CAST(sum(price) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) / CAST(sum(price) AS DOUBLE) AS b, CAST(count(*) AS DOUBLE) AS c FROM m)
SELECT 'KPI-01' AS kpi, 'Shipped in time' AS name, 'Production Controller' AS owner, a AS value, 95.0::DOUBLE AS target, CASE WHEN a >= 95 THEN 'on target' ELSE 'off target' END AS status FROM v
UNION ALL SELECT 'KPI-02', 'Returned value', 'Quality Manager', b, NULL, CASE WHEN b BETWEEN 0 AND 0.4 THEN 'on target' ELSE 'off target' END FROM v UNION ALL SELECT 'KPI-03', 'Lines', 'Finance Manager', c, NULL, 'for information' FROM v""")
def kpi_scorecard(spark, sf):
    views(spark, sf, "lineitem", "orders")
    return marts.build(spark, VIEWS, KPIS)


_LINES = "SELECT l_partkey, l_suppkey, l_orderkey, CAST(l_quantity AS BIGINT) AS quantity, CAST(l_extendedprice AS DECIMAL(12,2)) AS price, l_shipdate FROM lineitem"


@query("material_price", f"SELECT l_partkey, CAST(sum(quantity) AS BIGINT) AS quantity, CAST(sum(price) AS DOUBLE) AS value, CAST(sum(price) AS DOUBLE) / nullif(CAST(sum(quantity) AS DOUBLE), 0) AS price FROM ({_LINES}) GROUP BY l_partkey")
def material_price(spark, sf):
    views(spark, sf, "lineitem")
    value, quantity = F.sum("price").cast("double"), F.sum("quantity")
    return spark.sql(_LINES).groupBy("l_partkey").agg(quantity.alias("quantity"), value.alias("value"), F.try_divide(value, quantity.cast("double")).alias("price"))


@query("labour_variance", """
WITH booked AS (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS hours FROM lineitem GROUP BY 1)
SELECT o_custkey AS job, count(*) AS n_orders, count(*) FILTER (WHERE hours > planned) AS n_over, CAST(sum(planned) AS BIGINT) AS planned, CAST(sum(coalesce(hours, 0)) AS BIGINT) AS booked, CAST(sum(coalesce(hours, 0)) - sum(planned) AS DOUBLE) / nullif(CAST(sum(planned) AS DOUBLE), 0) AS variance
FROM (SELECT o_orderkey, o_custkey, o_orderkey % 90 AS planned FROM orders) o LEFT JOIN booked ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def labour_variance(spark, sf):
    booked = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("hours"))
    orders = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("job"), (F.col("o_orderkey") % 90).alias("planned"))
    hours, planned = F.sum(F.coalesce("hours", F.lit(0))), F.sum("planned")
    joined = orders.join(booked, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy("job").agg(F.count("*").alias("n_orders"), F.count_if(F.col("hours") > F.col("planned")).alias("n_over"), planned.alias("planned"), hours.alias("booked"), F.try_divide((hours - planned).cast("double"), planned.cast("double")).alias("variance"))


@query("despatch_within_window", """
SELECT o_orderkey, min(l_shipdate) AS first_despatch, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS n_suppliers FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 45 DAYS GROUP BY o_orderkey""")
def despatch_within_window(spark, sf):
    inside = F.col("l_shipdate").between(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 45 DAYS"))
    pairs = read(spark, sf, "orders").join(read(spark, sf, "lineitem"), (F.col("l_orderkey") == F.col("o_orderkey")) & inside)
    return pairs.groupBy("o_orderkey").agg(F.min("l_shipdate").alias("first_despatch"), F.count_distinct("l_suppkey").alias("n_suppliers"))


@query("category_labels", """
WITH v AS (SELECT CASE p_partkey % 3 WHEN 0 THEN upper(p_type) ELSE p_type END AS written, CAST(p_retailprice AS DECIMAL(12,2)) AS price FROM part), c AS (SELECT lower(written) AS key, written, count(*) AS n, sum(price) AS price FROM v GROUP BY 1, 2)
SELECT arg_min(written, (-n, written)) AS category, CAST(sum(n) AS BIGINT) AS n_reports, CAST(sum(price) AS DOUBLE) AS cost FROM c GROUP BY key""")
def category_labels(spark, sf):
    written = read(spark, sf, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.upper("p_type")).otherwise(F.col("p_type")).alias("written"), F.col("p_retailprice").cast("decimal(12,2)").alias("price"))
    spelled = written.groupBy("written").agg(F.count("*").alias("n"), F.sum("price").alias("price"))
    label = F.min(F.struct((-F.col("n")).alias("o"), F.col("written").alias("written")))["written"]
    return spelled.groupBy(F.lower("written").alias("_key")).agg(label.alias("category"), F.sum("n").alias("n_reports"), F.sum("price").cast("double").alias("cost")).drop("_key")


_DELIVERED = "SELECT o_custkey, c_mktsegment, date_diff('day', o_orderdate, l_shipdate) - 60 AS days_late, l_returnflag <> 'R' AS in_full FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"
_OTIF = "count(*) AS n, count(*) FILTER (WHERE days_late <= 0) AS on_time, count(*) FILTER (WHERE in_full) AS in_full, CAST(count(*) FILTER (WHERE days_late <= 0 AND in_full) AS DOUBLE) / count(*) AS otif, CAST(sum(greatest(days_late, 0)) AS BIGINT) AS days_late"


def _otif(spark, sf, key):
    """Deliveries judged by line and summed by ``key``; the customers' side is unique, so lines aren't doubled."""
    orders = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", "o_custkey", "c_mktsegment")
    lines = read(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    late, whole = F.datediff("l_shipdate", "o_orderdate") - 60, F.col("l_returnflag") != "R"
    return lines.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if(late <= 0).alias("on_time"), F.count_if(whole).alias("in_full"), (F.count_if((late <= 0) & whole).cast("double") / F.count("*")).alias("otif"),
        F.sum(F.greatest(late, F.lit(0))).cast("long").alias("days_late"),
    )


@query("otif_by_customer", f"SELECT o_custkey, {_OTIF} FROM ({_DELIVERED}) GROUP BY o_custkey")
def otif_by_customer(spark, sf):
    return _otif(spark, sf, "o_custkey")


@query("otif_by_site", f"SELECT c_mktsegment, {_OTIF} FROM ({_DELIVERED}) GROUP BY c_mktsegment")
def otif_by_site(spark, sf):
    return _otif(spark, sf, "c_mktsegment")


@query("labour_by_works_order", """
WITH booked AS (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS hours, count(*) AS n_bookings FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_orderkey % 90 AS planned, coalesce(hours, 0) AS booked, coalesce(n_bookings, 0) AS n_bookings, coalesce(hours, 0) - o_orderkey % 90 AS variance, coalesce(hours, 0) > o_orderkey % 90 AS over FROM orders LEFT JOIN booked ON l_orderkey = o_orderkey""")
def labour_by_works_order(spark, sf):
    booked = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("hours"), F.count("*").alias("n"))
    hours, planned = F.coalesce("hours", F.lit(0)), F.col("o_orderkey") % 90
    joined = read(spark, sf, "orders").join(booked, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", planned.alias("planned"), hours.alias("booked"), F.coalesce("n", F.lit(0)).alias("n_bookings"), (hours - planned).alias("variance"), (hours > planned).alias("over"))


def _materials(spark, sf):
    """Lines with their material and weight: size is kilograms a metre, quantity metres; a line without a part keeps a null weight."""
    part = read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_size")
    return read(spark, sf, "lineitem").join(part, "l_partkey", "left").withColumn("kg", F.col("l_quantity").cast("long") * F.col("p_size"))


@query("bom_line_material", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_type, CAST(CAST(l_quantity AS BIGINT) * p_size AS BIGINT) AS kg FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def bom_line_material(spark, sf):
    return _materials(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_type", F.col("kg").cast("long").alias("kg"))


@query("works_order_weight", "SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT) * p_size) AS BIGINT) AS kg, count(*) FILTER (WHERE p_partkey IS NULL) AS n_unweighed, count(DISTINCT p_type) AS n_types FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def works_order_weight(spark, sf):
    return _materials(spark, sf).groupBy("l_orderkey").agg(F.sum("kg").cast("long").alias("kg"), F.count_if(F.col("p_type").isNull()).alias("n_unweighed"), F.count_distinct("p_type").alias("n_types"))


@query("job_customer", "WITH v AS (SELECT l_suppkey, o_custkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) SELECT l_suppkey AS job, arg_min(o_custkey, (-n, o_custkey)) AS customer, count(*) AS n_customers, CAST(sum(n) AS BIGINT) AS n_lines FROM v GROUP BY l_suppkey")
def job_customer(spark, sf):
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    votes = read(spark, sf, "lineitem").join(orders, "l_orderkey").groupBy("l_suppkey", "o_custkey").agg(F.count("*").alias("_n"))
    return votes.groupBy(F.col("l_suppkey").alias("job")).agg(conformance.modal("o_custkey").alias("customer"), F.count("*").alias("n_customers"), F.sum("_n").alias("n_lines"))


@query("wip_works_orders", f"""
WITH l AS (SELECT l_orderkey, count(*) AS n_lines, count(*) FILTER (WHERE l_linestatus = 'F') AS n_done, max(CAST(l_shipdate AS DATE)) AS last_move FROM lineitem GROUP BY 1)
SELECT o_orderkey, date_diff('day', o_orderdate, TIMESTAMP '{AS_OF} 00:00:00') AS age_days, coalesce(n_lines, 0) AS n_lines, coalesce(n_done, 0) AS n_done, last_move, CAST(coalesce(n_done, 0) AS DOUBLE) / nullif(n_lines, 0) AS progress,
CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DOUBLE) AS value FROM orders LEFT JOIN l ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F'""")
def wip_works_orders(spark, sf):
    lines = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("done"), F.max(F.col("l_shipdate").cast("date")).alias("last_move"))
    orders = read(spark, sf, "orders").filter("o_orderstatus <> 'F'").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return orders.select(
        "o_orderkey", F.datediff(F.lit(AS_OF).cast("date"), "o_orderdate").alias("age_days"), zero("n").alias("n_lines"), zero("done").alias("n_done"), "last_move",
        F.try_divide(zero("done").cast("double"), F.col("n").cast("double")).alias("progress"), F.col("o_totalprice").cast("decimal(14,2)").cast("double").alias("value"),
    )


@query("capacity_by_site", """
WITH used AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, user_id % 4 AS site, count(*) AS used FROM events GROUP BY 1, 2), slots AS (SELECT site, (site + 1) * 40 AS available FROM range(4) t(site))
SELECT week, CAST(u.site AS BIGINT) AS site, used, CAST(available AS BIGINT) AS available, CAST(used AS DOUBLE) / available AS utilisation, used > available AS overbooked FROM used u JOIN slots s ON u.site = s.site""")
def capacity_by_site(spark, sf):
    used = read(spark, sf, "events").groupBy(F.date_trunc("week", "ts").cast("date").alias("week"), (F.col("user_id") % 4).cast("long").alias("site")).agg(F.count("*").alias("used"))
    slots = spark.range(4).select(F.col("id").alias("site"), ((F.col("id") + 1) * 40).alias("available"))
    both = used.join(F.broadcast(slots), "site")  # a row for each site
    return both.select("week", "site", "used", "available", (F.col("used").cast("double") / F.col("available")).alias("utilisation"), (F.col("used") > F.col("available")).alias("overbooked"))


@query("quality_cost_by_month", """
WITH s AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS shipped, sum(CAST(l_extendedprice AS DECIMAL(12,2))) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returns FROM lineitem GROUP BY 1)
SELECT month, CAST(shipped AS DOUBLE) AS shipped, CAST(coalesce(returned, 0) AS DOUBLE) AS returned, n_returns, CAST(coalesce(returned, 0) AS DOUBLE) / CAST(shipped AS DOUBLE) AS share FROM s""")
def quality_cost_by_month(spark, sf):
    money, back = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_returnflag") == "R"
    sums = read(spark, sf, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.sum(money).cast("double").alias("shipped"), F.coalesce(F.sum(F.when(back, money)).cast("double"), F.lit(0.0)).alias("returned"), F.count_if(back).alias("n_returns"))
    return sums.withColumn("share", F.try_divide("returned", "shipped"))


@query("quality_cost_of_all", """
WITH r AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
c AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS cancelled, sum(CAST(o_totalprice AS DECIMAL(14,2))) AS cancelled_value FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
e AS (SELECT strftime(ts, '%Y-%m') AS month, count(*) AS complaints FROM events WHERE event_type = 'search' GROUP BY 1)
SELECT month, CAST(coalesce(returned, 0) AS DOUBLE) AS returned, coalesce(cancelled, 0) AS cancelled, CAST(coalesce(cancelled_value, 0) AS DOUBLE) AS cancelled_value, coalesce(complaints, 0) AS complaints, CAST(coalesce(returned, 0) + coalesce(cancelled_value, 0) AS DOUBLE) AS cost FROM r FULL JOIN c USING (month) FULL JOIN e USING (month)""")
def quality_cost_of_all(spark, sf):
    """What three systems each record of poor quality, by month; a month that only one of them knows is there too."""
    month = lambda c: F.date_format(c, "yyyy-MM").alias("month")
    money = lambda c, kind: F.sum(F.col(c).cast(kind))
    returned = read(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy(month("l_shipdate")).agg(money("l_extendedprice", "decimal(12,2)").alias("returned"))
    cancelled = read(spark, sf, "orders").filter("o_orderstatus = 'P'").groupBy(month("o_orderdate")).agg(F.count("*").alias("cancelled"), money("o_totalprice", "decimal(14,2)").alias("cancelled_value"))
    complaints = read(spark, sf, "events").filter("event_type = 'search'").groupBy(month("ts")).agg(F.count("*").alias("complaints"))
    met = joins.full_outer([returned, cancelled, complaints], "month").na.fill(0)
    return met.select("month", F.col("returned").cast("double").alias("returned"), "cancelled", F.col("cancelled_value").cast("double").alias("cancelled_value"), "complaints", (F.col("returned") + F.col("cancelled_value")).cast("double").alias("cost"))
