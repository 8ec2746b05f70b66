"""Job cost: what a job's materials and hours should have cost against what finance has charged to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .numbering import numbered
from .reconcile import ORIGIN, Headline, explained, extremes, headlines

#: The sides that are compared and their components. Fixed values.
SUMS = {("mrp", "material"): "mrp_material", ("mrp", "labour (planned)"): "mrp_labour_planned", ("finance", "material"): "finance_material", ("finance", "labour"): "finance_labour", ("finance", "subcontract"): "finance_subcontract", ("finance", "plant"): "finance_plant", ("ops", "labour"): "ops_labour"}
MONEY = "decimal(18,2)"
CANCELLED = "CANCELLED"


def kilograms(qty: Column, uom: Column, mass: Column, each: Column) -> Column:
    """A quantity in kilograms, by mass a metre and mass a piece; null for another unit."""
    return F.when(uom == "KG", qty).when(uom == "M", qty * mass).when(uom == "EA", qty * each).cast("double")


def prices(purchases: DataFrame, masses: DataFrame) -> DataFrame:
    """material and price_per_kg, the average paid. purchases: material, qty, uom, value; masses: material, mass, kg_per_ea, unique by material.

    Sums are made by material and unit first, and are exact: they don't depend on the plan.
    """
    by_unit = purchases.groupBy("material", "uom").agg(F.sum("qty").alias("qty"), F.sum("value").alias("value"))
    weighed = by_unit.join(masses, "material").withColumn("kg", kilograms(F.col("qty").cast("double"), F.col("uom"), F.col("mass"), F.col("kg_per_ea")))
    # Three units at most, added in one order.
    one = weighed.groupBy("material").agg(*(F.sum(F.when(F.col("uom") == u, F.col("kg"))).alias(u) for u in ("KG", "M", "EA")), F.sum("value").cast("double").alias("value"))
    total = F.coalesce("KG", F.lit(0.0)) + F.coalesce("M", F.lit(0.0)) + F.coalesce("EA", F.lit(0.0))
    return one.select("material", F.try_divide("value", F.nullif(total, F.lit(0.0))).alias("price_per_kg"))


def detail(bom: DataFrame, orders: DataFrame, finance: DataFrame, bookings: DataFrame, priced: DataFrame, masses: DataFrame, rate: float) -> DataFrame:
    """Every line of cost: job, view, component, material, hours, amount, in_mrp, and its file and line where all sides have them.

    bom: order_no, material, qty, uom; orders: order_no, job, status, planned_hours; finance: job (null where the code isn't
    known), code, cost_type, amount; bookings: order_no, hours. Lines of cancelled orders cost nothing. Finance's unknown codes
    are jobs of their own, outside the plan. Bookings on orders that aren't there reach no job; see unallocated().
    """
    open_ = orders.filter(F.col("status") != CANCELLED)
    origin = [c for c in ORIGIN if all(c in df.columns for df in (bom, orders, finance, bookings))]
    rated = lambda hours: (hours.cast("double") * rate).cast(MONEY)
    told = lambda df, job, view, component, material, hours, amount, known=F.lit(True): df.select(job.alias("job"), F.lit(view).alias("view"), component.alias("component"), material.cast("string").alias("material"), hours.cast("double").alias("hours"), amount.cast(MONEY).alias("amount"), known.alias("in_mrp"), *origin)
    nothing = F.lit(None)
    lines = bom.join(open_.select("order_no", "job"), "order_no").join(masses, "material").join(priced, "material", "left")
    mass = F.when(F.col("uom") == "KG", F.col("qty")).otherwise(F.col("qty") * F.col("mass")).cast("double")
    known = F.col("job").isNotNull()
    return (
        told(lines, F.col("job").cast("string"), "mrp", F.lit("material"), F.col("material"), nothing, mass * F.col("price_per_kg"))
        .unionByName(told(open_, F.col("job").cast("string"), "mrp", F.lit("labour (planned)"), nothing, F.col("planned_hours"), rated(F.col("planned_hours"))))
        .unionByName(told(finance, F.coalesce(F.col("job").cast("string"), F.concat(F.lit("finance "), "code")), "finance", F.col("cost_type"), nothing, nothing, F.col("amount"), known))
        .unionByName(told(bookings.join(orders.select("order_no", "job"), "order_no"), F.col("job").cast("string"), "ops", F.lit("labour"), nothing, F.col("hours"), rated(F.col("hours"))))
    )


def assert_priced(lines: DataFrame) -> None:
    """A material without a price can't be valued, so a job that uses it can't be reconciled."""
    missing = lines.filter("view = 'mrp' and component = 'material' and amount is null").groupBy("material").agg(F.count("*").alias("n")).orderBy("material").first()
    if missing:
        raise AssertionError(f"{missing['n']} lines of {missing['material']} have no purchase price")


def unallocated(bookings: DataFrame, orders: DataFrame) -> DataFrame:
    """Bookings on orders that aren't there."""
    return bookings.join(orders.select("order_no").distinct(), "order_no", "left_anti")


def materials(lines: DataFrame, invoiced: DataFrame) -> DataFrame:
    """job, item, planned (issued), actual (invoiced) and gap by material. invoiced: job, material, amount."""
    issued = lines.filter("view = 'mrp' and component = 'material'").select("job", F.col("material").alias("item"), "amount")
    return explained(issued, invoiced.select(F.col("job").cast("string").alias("job"), F.col("material").alias("item"), F.col("amount").cast(MONEY).alias("amount")), ["job", "item"], "amount")


def jobs(lines: DataFrame, by_material: DataFrame) -> DataFrame:
    """One row for each job, ranked by its unexplained gap: the sums of SUMS, hours, gaps and their shares, and what explains them."""
    of = lambda view, component: (F.col("view") == view) & (F.col("component") == component)
    zero = F.lit(0).cast(MONEY)
    one = lines.groupBy("job").agg(
        *(F.coalesce(F.sum(F.when(of(*k), F.col("amount"))).cast(MONEY), zero).alias(name) for k, name in SUMS.items()), F.bool_and("in_mrp").alias("in_mrp"),
        F.coalesce(F.sum(F.when(F.col("view") == "ops", F.col("hours").cast(MONEY))), zero).cast("double").alias("ops_hours"), F.coalesce(F.sum(F.when(of("mrp", "labour (planned)"), F.col("hours").cast(MONEY))), zero).cast("double").alias("planned_hours"),
    )
    gap = one.withColumns({"material_gap": F.col("finance_material") - F.col("mrp_material"), "labour_gap": F.col("finance_labour") - F.col("ops_labour"), "reference_cost": F.col("mrp_material") + F.col("ops_labour")})
    gap = gap.withColumn("unexplained_gap", F.col("material_gap") + F.col("labour_gap"))
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.nullif(F.col(b).cast("double"), F.lit(0.0)))
    gap = gap.withColumns({"gap_pct": share("unexplained_gap", "reference_cost"), "labour_gap_pct": share("labour_gap", "ops_labour"), "hours_vs_plan_pct": F.try_divide(F.col("ops_hours") - F.col("planned_hours"), F.nullif("planned_hours", F.lit(0.0)))})
    most = extremes(by_material, "job", "item").select("job", "most_over", "over", "most_under", "under")
    met = gap.join(most, "job", "left")
    pounds = lambda c: F.concat(F.lit("£"), F.format_string("%,.0f", F.floor(c.cast("double") + 0.5).cast("double")))
    none = F.lit("")
    over = F.when(F.col("over").isNotNull(), F.concat(F.lit("; charged "), pounds(F.col("over")), F.lit(" more "), "most_over", F.lit(" than issued"))).otherwise(none)
    under = F.when(F.col("under").isNotNull(), F.concat(F.lit("; issued "), pounds(-F.col("under")), F.lit(" of "), "most_under", F.lit(" charged elsewhere"))).otherwise(none)
    material = F.when(F.abs("material_gap") >= 1, F.concat(F.lit("finance material "), pounds(F.col("finance_material")), F.lit(" vs planned material "), pounds(F.col("mrp_material")), over, under))
    labour = F.when(F.abs("labour_gap") >= 1, F.concat(F.lit("finance labour "), pounds(F.col("finance_labour")), F.lit(" vs "), F.format_string("%,.1f", "ops_hours"), F.lit(" booked hours ("), pounds(F.col("ops_labour")), F.lit(")")))
    said = F.coalesce(F.nullif(F.concat_ws("; ", material, labour), none), F.lit("reconciles"))
    text = F.when(~F.col("in_mrp"), "finance job code with no planned job: none of this cost has an operational record").otherwise(said)
    told = met.withColumn("explanation", text).drop("most_over", "over", "most_under", "under")
    return numbered(told, [F.abs("unexplained_gap").desc(), "job"], "rank")


def figures(spark: SparkSession, ranked: DataFrame, lines: DataFrame, lost: DataFrame) -> list[Headline]:
    """The figures of job costs, over the tables job_cost, job_cost_detail and unallocated_bookings."""
    top = ranked.filter("rank = 1").first()
    asked = [
        ("gross_gap", "true", "round(sum(abs(unexplained_gap)), 2)"), ("net_gap", "true", "round(sum(unexplained_gap), 2)"), ("labour_gap_gross", "true", "round(sum(abs(labour_gap)), 2)"), ("material_gap_gross", "in_mrp", "round(sum(abs(material_gap)), 2)"),
        ("material_misallocated", "in_mrp", "round(sum(abs(material_gap)) - abs(sum(material_gap)), 2)"), ("jobs_over_10pct", "abs(gap_pct) > 0.10", "count(*)"),
    ]
    if top:
        asked.append(("top_job_gap", "rank = 1", "round(sum(unexplained_gap), 2)"))
    totals = [(f"total_{SUMS[k]}", f"view = '{k[0]}' AND component = '{k[1]}'", "round(sum(amount), 2)") for k in (("mrp", "material"), ("finance", "material"), ("finance", "labour"), ("ops", "labour"))]
    return [
        *headlines("job_cost", "job_cost", ranked, asked), *headlines("job_cost", "job_cost_detail", lines, [("finance_only_cost", "NOT in_mrp", "round(sum(amount), 2)"), *totals]),
        *headlines("job_cost", "unallocated_bookings", lost, [("unallocated_hours", "true", "round(sum(CAST(hours AS DECIMAL(18,2))), 2)")]),
    ]
