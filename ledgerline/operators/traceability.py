"""Material traceability: what covers a line, where its chain breaks, and what a despatched break exposes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a chain of material can break, first failing first. Fixed values.
LINKS = ("receipt: heat number missing", "receipt: mill certificate missing", "issue: receipt grade unconfirmed", "issue: no receipt on record")
NOT_DESPATCHED, COMPLETE = "despatch: no delivery note", "complete"
#: What a despatched line can expose, worst first. Fixed values.
EXPOSURES = ("EN 1090: EXC3 chain incomplete", "EN 1090: S355 with no 3.1 document shown", "good practice: EXC2 chain incomplete")


def coverage(lines: DataFrame, allocations: DataFrame, receipts: DataFrame) -> DataFrame:
    """``lines`` (line_id, kg) with kg_allocated, kg_short, heat_ok, cert_ok, and the ids of receipts and of those that lack a document.

    allocations: line_id, receipt_id, kg; receipts: receipt_id, heat_number, mill_cert_ref. A line without allocations has
    nothing that lacks a document, and is short. Ids are listed in the order of their text, so the lists do not depend on the plan.
    """
    papers = receipts.select("receipt_id", F.col("heat_number").isNotNull().alias("_heat"), F.col("mill_cert_ref").isNotNull().alias("_cert"))
    listed = lambda test: F.array_join(F.array_sort(F.collect_list(F.when(test, F.col("receipt_id").cast("string")))), ", ")
    known = F.coalesce("_heat", F.lit(False)), F.coalesce("_cert", F.lit(False))
    per_line = (
        allocations.join(papers, "receipt_id", "left").groupBy("line_id")
        .agg(F.sum("kg").alias("_kg"), F.bool_and(known[0]).alias("_heat_ok"), F.bool_and(known[1]).alias("_cert_ok"), listed(F.lit(True)).alias("receipts"), listed(~known[0]).alias("missing_heat"), listed(~known[1]).alias("missing_cert"))
    )
    got = F.coalesce(F.col("_kg").cast("double"), F.lit(0.0))
    return lines.join(per_line, "line_id", "left").select(
        *(lines[c] for c in lines.columns), got.alias("kg_allocated"), F.round(F.greatest(F.col("kg") - got, F.lit(0.0)), 3).alias("kg_short"),
        F.coalesce("_heat_ok", F.lit(True)).alias("heat_ok"), F.coalesce("_cert_ok", F.lit(True)).alias("cert_ok"),
        *(F.coalesce(c, F.lit("")).alias(c) for c in ("receipts", "missing_heat", "missing_cert")),
    )


def break_at(unconfirmed: Column, finished: Column, despatched: Column, slack: float = 0.5) -> Column:
    """The first link that fails, over the columns of coverage()."""
    short = F.col("kg_short") > slack
    return (
        F.when(~F.col("heat_ok"), LINKS[0]).when(~F.col("cert_ok"), LINKS[1])
        .when(short & F.coalesce(unconfirmed, F.lit(False)), LINKS[2]).when(short, LINKS[3])
        .when(finished & ~despatched, NOT_DESPATCHED).otherwise(COMPLETE)
    )


def traced(lines: DataFrame, slack: float = 0.5) -> DataFrame:
    """Lines of coverage() with unconfirmed, finished, despatched, execution_class and grade, to their verdicts.

    break_at, material_chain_complete, traceability_required (any class but EXC2, unknown ones too), document_31_shown
    (null for other grades than S355), exposure (null where nothing is exposed), compliance_exposure and practice_gap.
    """
    whole, s355 = ~F.col("break_at").isin(*LINKS), F.coalesce(F.col("grade"), F.lit("")).startswith("S355")
    shown = F.when(s355, F.col("cert_ok") & (F.col("kg_short") <= slack))
    needed = ~F.coalesce(F.col("execution_class") == "EXC2", F.lit(False))
    exposed = F.when(F.col("despatched"), F.when(needed & ~whole, EXPOSURES[0]).when(s355 & ~shown, EXPOSURES[1]).when(~whole, EXPOSURES[2]))
    return (
        lines.withColumn("break_at", break_at(F.col("unconfirmed"), F.col("finished"), F.col("despatched"), slack))
        .withColumns({"material_chain_complete": whole, "traceability_required": needed, "document_31_shown": shown, "exposure": exposed})
        .withColumns({"compliance_exposure": F.coalesce(F.col("exposure").isin(*EXPOSURES[:2]), F.lit(False)), "practice_gap": F.coalesce(F.col("exposure") == EXPOSURES[2], F.lit(False))})
    )


def rollup(lines: DataFrame, by: list[str]) -> DataFrame:
    """Traced lines by job, customer or any other columns: lines, kg, kg traced and its share, and what is exposed."""
    kg = lambda test: F.sum(F.when(test, F.col("kg")).otherwise(0.0))
    whole, risk, gap = F.col("material_chain_complete"), F.col("compliance_exposure"), F.col("practice_gap")
    return lines.groupBy(*by).agg(
        F.count("*").alias("n_lines"), F.sum("kg").alias("kg"), kg(whole).alias("kg_traced"), F.try_divide(kg(whole), F.sum("kg")).alias("coverage"), F.count_if(~whole).alias("broken_lines"),
        F.count_if("despatched").alias("despatched_lines"), F.count_if(risk).alias("exposed_lines"), kg(risk).alias("exposed_kg"), F.count_if(gap).alias("gap_lines"), kg(gap).alias("gap_kg"),
    )


_SHARE, _TONNES = "round(100 * sum(CASE WHEN material_chain_complete THEN kg ELSE 0 END) / nullif(sum(kg), 0), 2)", "round(sum(kg) / 1000, 3)"
#: The figures of traced lines, of their jobs and of receipts: key, condition and aggregate. Fixed values.
HEADLINES = {
    "traced_lines": [
        ("coverage", "true", _SHARE), ("coverage_exc3", "traceability_required", _SHARE), ("coverage_exc2", "NOT traceability_required", _SHARE),
        ("exposed_kg", "compliance_exposure", _TONNES), ("exposed_kg_exc3", f"exposure = '{EXPOSURES[0]}'", _TONNES), ("exposed_kg_s355", f"exposure = '{EXPOSURES[1]}'", _TONNES), ("gap_kg", "practice_gap", _TONNES),
        *((f"break_{link.split(': ')[1].replace(' ', '_')}", f"break_at = '{link}'", "count(*)") for link in (*LINKS, NOT_DESPATCHED)),
    ],
    "trace_jobs": [
        ("exposed_jobs", "en1090_exposure", "count(*)"), ("exposed_customers", "en1090_exposure", "count(DISTINCT customer)"), ("exposed_sales", "en1090_exposure", "round(sum(sales_value), 2)"), ("gap_jobs", "practice_gap", "count(*)"),
    ],
    "trace_receipts": [("s355_receipts_no_31", "s355 AND NOT document_31", "count(*)")],
}
NO_CUSTOMER = "(no finance customer)"


def jobs(lines: DataFrame, sales: DataFrame) -> DataFrame:
    """Traced lines, which have a job, by job: rollup() with customer and sales_value of ``sales`` (job, customer, sales_value, unique by job; 0 where it has none), en1090_exposure and practice_gap."""
    met = rollup(lines, ["job"]).join(sales.select("job", "customer", "sales_value"), "job", "left")
    return met.withColumns({"customer": F.coalesce("customer", F.lit(NO_CUSTOMER)), "sales_value": F.coalesce("sales_value", F.lit(0)), "en1090_exposure": F.col("exposed_lines") > 0, "practice_gap": F.col("gap_lines") > 0})


def receipts_shown(receipts: DataFrame) -> DataFrame:
    """``receipts`` (with grade and mill_cert_ref) with s355 and document_31: whether there is an inspection document."""
    return receipts.withColumns({"s355": F.coalesce(F.col("grade"), F.lit("")).startswith("S355"), "document_31": F.col("mill_cert_ref").isNotNull()})


def coverage_by(lines: DataFrame, by: list[str]) -> DataFrame:
    """Kilograms and the share of them whose chain is complete, in all and of what must be traced, by month, site, class or any other columns."""
    kg = lambda test: F.sum(F.when(test, F.col("kg")).otherwise(0.0))
    whole, needed = F.col("material_chain_complete"), F.col("traceability_required")
    return lines.groupBy(*by).agg(
        F.count("*").alias("n_lines"), F.sum("kg").alias("kg"), F.try_divide(kg(whole), F.sum("kg")).alias("coverage"), kg(needed).alias("required_kg"), F.try_divide(kg(whole & needed), kg(needed)).alias("required_coverage"), kg(F.col("compliance_exposure")).alias("exposed_kg")
    )
