"""Governance over what the engines publish: the catalogue of rules and what each did, who owns what, and what is unresolved."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runs import RAW_RULES
from .staging import RULES

#: The other rules by id, with what they do. Ids are stable: lineage and registers name them. Fixed values.
LATER_RULES = {
    "ST-01": "white space at both ends of every cell goes", "ST-09": "blank cells are null and columns have their declared types",
    "CO-01": "works order number read from free text", "CO-02": "site spelling to site code", "CO-03": "job reference to one form, and to finance's code", "CO-04": "operation spelling to routing operation",
    "CO-05": "parents are matched by a flag and orphans stay", "CO-06": "a conformed table has as many rows as its staged one",
    "MA-01": "material text to section, dimensions, grade and code", "MA-02": "one golden record for each material", "MA-03": "supplier names paired by likeness", "MA-04": "jobs of three systems linked", "MA-05": "works order forms read, and swapped digits proposed",
    "RC-01": "orders, receipts and invoices matched", "RC-02": "views of a job's cost compared", "RC-03": "book stock compared with the count", "RC-04": "receipts allocated to lines and chains checked",
}
LAYERS = {"RAW": "raw", "ST": "staging", "CO": "core", "MA": "core", "RC": "reconciliation"}


def catalogue(spark: SparkSession) -> DataFrame:
    """rule, layer and rule_text of every rule that can stand in lineage or in a register."""
    every = RAW_RULES | RULES | LATER_RULES
    listed = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(LAYERS[rule.split("-")[0]]).alias("layer"), F.lit(text).alias("rule_text")) for rule, text in sorted(every.items())))
    return spark.range(1).select(F.inline(listed))


def activity(rules: DataFrame, lineages: list[DataFrame]) -> DataFrame:
    """Every rule of catalogue() with the rows that it saw, passed and rejected over all ``lineages`` (rule, rows_in, rows_out, rows_rejected).

    A rule that no lineage names has nulls, so rules that never ran can be told from rules that rejected nothing. A name that
    isn't in the catalogue is kept with a null layer, to be seen.
    """
    summed = [F.sum(c).cast("long").alias(c) for c in ("rows_in", "rows_out", "rows_rejected")]
    named = reduce(DataFrame.unionByName, [df.select("rule", "rows_in", "rows_out", "rows_rejected") for df in lineages])
    return rules.join(named.groupBy("rule").agg(*summed), "rule", "full")


def lineage_of(rule: str, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row of lineage for a step from one table to another that may lose rows."""
    sizes = before.agg(F.count("*").alias("rows_in")).crossJoin(after.agg(F.count("*").alias("rows_out")))  # one row each
    return sizes.select(F.lit(rule).alias("rule"), "rows_in", "rows_out", (F.col("rows_in") - F.col("rows_out")).alias("rows_rejected"))


def ownership(results: DataFrame, exceptions: DataFrame, scorecard: DataFrame) -> DataFrame:
    """A row for each owner of a rule: rules, critical_rules, rules_breaching, open_exceptions, kpis_owned and kpis_off_target.

    results: owner, severity, met (null: not scored, so not breaching); exceptions: owner; scorecard: owner, status. Each side
    is summed by owner before they meet.
    """
    rules = results.groupBy("owner").agg(F.count("*").alias("rules"), F.count_if(F.col("severity") == "critical").alias("critical_rules"), F.count_if(~F.col("met")).alias("rules_breaching"))
    failing = exceptions.groupBy("owner").agg(F.count("*").alias("open_exceptions"))
    kpis = scorecard.groupBy("owner").agg(F.count("*").alias("kpis_owned"), F.count_if(F.col("status") == "off target").alias("kpis_off_target"))
    return rules.join(failing, "owner", "left").join(kpis, "owner", "left").fillna(0, ["open_exceptions", "kpis_owned", "kpis_off_target"])


def rules_by_system(results: DataFrame, systems: list[str]) -> DataFrame:
    """How many rules each owner has for each of ``systems``, a column each, zero where there are none."""
    return results.groupBy("owner").pivot("system", systems).count().fillna(0)


def chosen(exceptions: DataFrame, owners: tuple[str, ...] = (), severities: tuple[str, ...] = (), rules: tuple[str, ...] = ()) -> DataFrame:
    """The ``exceptions`` of these owners, severities and rules; an empty choice takes all."""
    picks = {"owner": owners, "severity": severities, "rule_id": rules}
    return reduce(lambda df, c: df.filter(F.col(c).isin(*picks[c])) if picks[c] else df, picks, exceptions)


def unresolved(forms: DataFrame) -> DataFrame:
    """Numbers that are written but not held: parsed_number, written_as (each form once, in order), rows and matched_on.

    forms: parsed_number, source_value, row_count, matched_on, wo_no (null: not held). Of several reasons the least is given;
    forms without a number are one row, with a null number.
    """
    lost = forms.filter(F.col("wo_no").isNull()).groupBy("parsed_number", "source_value").agg(F.sum("row_count").alias("n"), F.min("matched_on").alias("why"))
    return lost.groupBy("parsed_number").agg(F.array_join(F.array_sort(F.collect_list("source_value")), ", ").alias("written_as"), F.sum("n").cast("long").alias("rows"), F.min("why").alias("matched_on"))
