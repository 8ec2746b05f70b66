"""Reconciliations: tolerances, ageing, the three-way match, cost gaps, and headline figures that verify themselves."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def beyond(gap: Column, tolerance: Column) -> Column:
    """Whether a gap exceeds a tolerance; a gap on the tolerance does not, whatever the floating point."""
    return F.abs(gap) > tolerance + F.greatest(F.lit(1.0), tolerance) * 1e-9


def age_bucket(days: Column, bounds: list[int] = (30, 60, 90, 180)) -> Column:
    """0-30 days, 31-60 days and so on, over 180 days; null for null."""
    out, low = F.lit(f"over {bounds[-1]} days"), [0, *(b + 1 for b in bounds)]
    for a, b in reversed(list(zip(low, bounds, strict=False))):
        out = F.when(days <= b, f"{a}-{b} days").otherwise(out)
    return F.when(days.isNotNull(), out)


#: The categories in order of reporting. Fixed values.
CATEGORIES = ("matched", "quantity variance", "price variance", "missing GRN", "missing invoice", "invoice with no PO", "not yet due")


RISK = "decimal(20,6)"
#: Where a row comes from; staging, core and reconciliations carry it along.
ORIGIN = ("_source_file", "_source_row")


def three_way(lines: DataFrame, as_of: str, receipt_grace: int = 5, invoice_grace: int = 30, price_tolerance: float = 0.05, quantity_tolerance: float = 0.02) -> DataFrame:
    """``lines`` with category, value_at_risk (decimal, so sums don't depend on their order), exception_date and reason.

    Needs ordered, received, received_value, invoiced, order_value (decimals), promised, received_on and invoiced_on (dates);
    received and invoiced are null where there is none. The first test that holds decides: nothing received, nothing invoiced,
    price beyond tolerance, quantity beyond tolerance, matched. A line whose grace ends after as_of is not yet due. What is
    missing dates from when it was due or received, a variance from the invoice.
    """
    today = F.lit(as_of).cast("date")
    received, ordered, worth, billed = (F.col(c).cast("double") for c in ("received", "ordered", "received_value", "invoiced"))
    receipt_due, invoice_due = F.date_add("promised", receipt_grace), F.date_add("received_on", invoice_grace)
    over = beyond(billed - worth, worth * price_tolerance)
    short = beyond(received - ordered, ordered * quantity_tolerance)
    none, zero = F.lit(None).cast("date"), F.lit(0)
    # Pence are rounded as a double's hundredfold is: 1.005 is 1.00, for it lies below, though F.round(c, 2) goes by its digits.
    day, money = (lambda c: F.date_format(c, "dd/MM/yyyy")), (lambda c: F.concat(F.lit("£"), F.format_string("%,.2f", F.round(c * 100) / 100)))
    near = lambda c, digits: F.floor(c * 10**digits + 0.5) / 10**digits
    share = F.format_string("%+.1f%%", near(F.try_divide((received - ordered) * 100, ordered), 1))
    verdict = lambda category, risk, date, *told: F.struct(F.lit(category).alias("category"), risk.cast(RISK).alias("value_at_risk"), date.alias("exception_date"), F.concat(*(F.lit(t) if isinstance(t, str) else t for t in told)).alias("reason"))
    # A double becomes a risk by its millionfold, rounded, as in SQL, and not by its digits.
    exact = lambda c: F.round(c * 10**6).cast("decimal(26,0)") * F.lit("0.000001").cast("decimal(6,6)")
    ladder = (
        F.when(F.col("received").isNull(), F.when(receipt_due > today, verdict("not yet due", zero, none, "promised ", day("promised"), "; not due for receipt until ", day(receipt_due)))
               .otherwise(verdict("missing GRN", F.col("order_value"), F.col("promised"), "promised ", day("promised"), ", nothing received; ", money(F.col("order_value").cast("double")), " committed")))
        .when(F.col("invoiced").isNull(), F.when(invoice_due > today, verdict("not yet due", zero, none, "received ", day("received_on"), "; invoice not due until ", day(invoice_due)))
              .otherwise(verdict("missing invoice", F.col("received_value"), F.col("received_on"), "received ", day("received_on"), ", not invoiced; ", money(worth), " unaccrued")))
        .when(over, verdict("price variance", F.abs(F.col("invoiced") - F.col("received_value")), F.col("invoiced_on"), "invoiced ", money(billed), " against ", money(worth), " expected; tolerance ", money(near(worth * price_tolerance, 2))))
        .when(short, verdict("quantity variance", exact(F.abs(received - ordered) * worth / received), F.col("invoiced_on"), "ordered ", F.format_string("%.0f", ordered), ", received ", F.format_string("%.0f", received), " (", share, f"); tolerance {quantity_tolerance:.0%}"))
        .otherwise(verdict("matched", zero, none, "received ", F.format_string("%.0f", received), " of ", F.format_string("%.0f", ordered), "; invoice within ", money(near(worth * price_tolerance, 2))))
    )
    return lines.withColumn("_v", ladder).select("*", "_v.category", "_v.value_at_risk", "_v.exception_date", "_v.reason").drop("_v")


def both_sides(orders: DataFrame, invoices: DataFrame, order_id: str, invoice_id: str) -> DataFrame:
    """Judged order lines and invoices without an order in one table: line_type, line_id, category, value_at_risk, exception_date, and the file and line of each where both sides have them."""
    origin = [c for c in ORIGIN if c in orders.columns and c in invoices.columns]
    side = lambda df, kind, key: df.select(F.lit(kind).alias("line_type"), F.col(key).cast("string").alias("line_id"), "category", F.col("value_at_risk").cast(RISK).alias("value_at_risk"), "exception_date", *origin)
    return side(orders, "PO line", order_id).unionByName(side(invoices, "invoice", invoice_id))


def raw_behind(rows: DataFrame, received: DataFrame) -> DataFrame:
    """The lines as received behind the rows of a figure, each once: ``received`` (_source_file, _source_row, line) of the files and lines that ``rows`` name."""
    return received.join(rows.select(*ORIGIN).filter("_source_file is not null").distinct(), list(ORIGIN), "left_semi")


def headlines(engine: str, table: str, rows: DataFrame, asked: list[tuple[str, str, str]]) -> list[Headline]:
    """Figures (key, condition, aggregate) over ``rows``, all in one pass; a sum of no rows is 0.

    Each names the published table, the condition and the aggregate that verify() recomputes it with. An aggregate is made of
    counts and sums.
    """
    whole = [(key, where, a if a.startswith("count") else f"coalesce({a}, 0)") for key, where, a in asked]
    found = rows.agg(*(F.expr(_filtered(a, where)).cast("double").alias(key) for key, where, a in whole)).first()
    return [Headline(engine, key, found[key], table, where, a) for key, where, a in whole]


def _filtered(aggregate: str, where: str) -> str:
    return re.sub(r"((?:count|sum)\((?:[^()]|\([^()]*\))*\))", rf"\1 FILTER (WHERE {where})", aggregate)


def exception_headlines(table: str, rows: DataFrame, as_of: str) -> list[Headline]:
    """The match's figures: value at risk, lines of each category, value of each exception, and lines over 90 days."""
    risk = "round(sum(value_at_risk), 2)"
    old = f"exception_date IS NOT NULL AND datediff(DATE '{as_of}', exception_date) > 90"
    asked = [("value_at_risk", "exception_date IS NOT NULL", risk), ("over_90_days", old, "count(*)")]
    for c in CATEGORIES:
        key = c.replace(" ", "_")
        asked.append((f"{key}_lines", f"category = '{c}'", "count(*)"))
        if c not in ("matched", "not yet due"):
            asked.append((f"{key}_value", f"category = '{c}'", risk))
    return headlines("three_way", table, rows, asked)


def summary(rows: DataFrame, category: str, categories: tuple[str, ...], value: str) -> DataFrame:
    """Count and sum by category, with a row for the categories that are empty."""
    every = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, categories))).alias(category))
    counted = rows.groupBy(category).agg(F.count("*").alias("n_rows"), F.sum(value).alias("total"))
    return every.join(F.broadcast(counted), category, "left").select(category, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce(F.col("total").cast("double"), F.lit(0.0)).alias("total"))


def gaps(rows: DataFrame, keys: list[str], side: str, sides: tuple[str, str], component: str, components: tuple[str, ...], value: str) -> DataFrame:
    """Both sides pivoted by component: planned and actual of each, their gaps, the gap in all, and its share of the plan."""
    columns = [F.coalesce(F.sum(F.when((F.col(side) == s) & (F.col(component) == c), F.col(value))), F.lit(0)).alias(f"{s}_{c}") for s in sides for c in components]
    wide = rows.groupBy(*keys).agg(*columns)
    by = {c: F.col(f"{sides[1]}_{c}") - F.col(f"{sides[0]}_{c}") for c in components}
    total, plan = sum(by.values(), F.lit(0)), sum((F.col(f"{sides[0]}_{c}") for c in components), F.lit(0))
    return wide.select(*keys, *(f"{s}_{c}" for s in sides for c in components), *(g.alias(f"gap_{c}") for c, g in by.items()), total.alias("gap"), F.try_divide(total.cast("double"), F.nullif(plan.cast("double"), F.lit(0.0))).alias("gap_share"))


@dataclass(frozen=True)
class Headline:
    """A published figure and the rows behind it: aggregate over table where condition."""

    engine: str
    key: str
    value: float
    table: str
    where: str
    aggregate: str

    @property
    def value_sql(self) -> str:
        return f"SELECT {self.aggregate} AS value FROM {self.table} WHERE {self.where}"

    @property
    def rows_sql(self) -> str:
        return f"SELECT * FROM {self.table} WHERE {self.where}"


def verify(spark: SparkSession, headlines: list[Headline]) -> None:
    """Recomputes every figure from the rows of its published table; a figure that cannot be reproduced stops publication.

    The figures of a table are one aggregation of it.
    """
    wrong = []
    for name in sorted({h.table for h in headlines}):
        own = [h for h in headlines if h.table == name]
        tests = [_filtered(h.aggregate, h.where) for h in own]
        found = spark.sql(f"SELECT {', '.join(f'CAST({t} AS DOUBLE) AS _{k}' for k, t in enumerate(tests))} FROM {name}").first()
        wrong += [f"{h.engine}.{h.key}: {h.value} published, {v} found" for h, v in zip(own, found, strict=True) if v is None or abs(v - h.value) > max(0.011, 1e-9 * abs(h.value))]
    if wrong:
        raise AssertionError("; ".join(wrong))


def without_order(invoices: DataFrame, orders: DataFrame, exempt: tuple[str, ...] = ()) -> DataFrame:
    """Invoices whose order is not known or not named, but for exempt nominals: category, value_at_risk and exception_date are added.

    invoices: po_no, nominal, amount, invoiced_on; orders: po_no. A null nominal is not exempt.
    """
    known = orders.select("po_no").filter("po_no is not null").distinct()
    lost = invoices.join(known, "po_no", "left_anti")
    if exempt:
        lost = lost.filter(~F.coalesce(F.col("nominal").isin(*exempt), F.lit(False)))
    return lost.select("*", F.lit(CATEGORIES[5]).alias("category"), F.col("amount").alias("value_at_risk"), F.col("invoiced_on").alias("exception_date"))


def explained(planned: DataFrame, actual: DataFrame, keys: list[str], value: str) -> DataFrame:
    """planned, actual and gap by ``keys``, which either side may lack (0). Both sides are summed before they meet."""
    p, a = (df.groupBy(*keys).agg(F.sum(value).alias(n)) for df, n in ((planned, "planned"), (actual, "actual")))
    both = p.join(a, keys, "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast(both.schema[c].dataType))
    return both.select(*keys, zero("planned").alias("planned"), zero("actual").alias("actual"), (zero("actual") - zero("planned")).alias("gap"))


def extremes(gaps_by_item: DataFrame, job: str, item: str) -> DataFrame:
    """Of each job: its gap, the item that is most over and the one most under, with their gaps (null if none is); ties by item."""
    most = lambda sign, name: F.min(F.when(F.col("gap") * sign > 0, F.struct((-F.col("gap") * sign).alias("o"), F.col(item).alias("item"), F.col("gap").alias("gap")))).alias(name)
    one = gaps_by_item.groupBy(job).agg(F.sum("gap").alias("gap"), F.sum(F.abs("gap")).alias("gross"), most(1, "_over"), most(-1, "_under"))
    return one.select(job, "gap", "gross", F.col("_over.item").alias("most_over"), F.col("_over.gap").alias("over"), F.col("_under.item").alias("most_under"), F.col("_under.gap").alias("under"))
