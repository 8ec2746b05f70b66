"""The staging rule chain: text rows to typed rows, quarantine and lineage, in two windows and one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import coerce_number, parse_date, strip
from ..sources.contracts import TYPES, TableContract
from .numbering import identified

#: The rules in order; each sees only what the ones before it let through. Fixed values.
RULES = {
    "ST-02": "exact duplicate of an earlier row",
    "ST-03": "required column is blank",
    "ST-04": "date in none of the declared formats",
    "ST-05": "not a number",
    "ST-06": "not a whole number",
    "ST-07": "value outside the declared domain",
    "ST-08": "natural key of an earlier row",
}


def _tests(contract: TableContract) -> dict[str, list[tuple[str, Column]]]:
    """By rule: (column, failing) in contract order, over stripped cells."""
    out: dict[str, list[tuple[str, Column]]] = {r: [] for r in RULES}
    for c in contract.columns:
        cell = F.col(c.name)
        filled = cell != ""
        if c.required:
            out["ST-03"].append((c.name, ~filled))
        if c.type == "date":
            out["ST-04"].append((c.name, filled & parse_date(cell, list(c.formats)).isNull()))
        if c.type in ("decimal", "integer"):
            out["ST-05"].append((c.name, filled & coerce_number(cell).isNull()))
        if c.type == "integer":
            out["ST-06"].append((c.name, filled & ~F.coalesce(coerce_number(cell).rlike(r"^[+-]?\d+$"), F.lit(True))))
        if c.domain:
            out["ST-07"].append((c.name, filled & ~cell.isin(*c.domain)))
    return out


def judge(raw: DataFrame, contract: TableContract) -> DataFrame:
    """``raw`` with stripped cells, and rule and failing_column of the first rule that rejects a row (null: it stays).

    ``original`` keeps the row as received, as a struct. Ties of duplicates go to the smallest _source_file and
    _source_row. Null cells count as blank.
    """
    names = contract.names
    cells = raw.select(*(strip(F.coalesce(F.col(n), F.lit(""))).alias(n) for n in names), F.struct(*names).alias("original"), "_source_file", "_source_row")
    same = Window.partitionBy(F.xxhash64(*names), *names).orderBy("_source_file", "_source_row")
    marked = cells.withColumn("_copy", F.row_number().over(same) > 1)
    tests = _tests(contract)
    rule, column = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in reversed(["ST-03", "ST-04", "ST-05", "ST-06", "ST-07"]):
        for c, fails in reversed(tests[name]):
            rule, column = F.when(fails, name).otherwise(rule), F.when(fails, c).otherwise(column)
    marked = marked.withColumn("rule", F.when(F.col("_copy"), "ST-02").otherwise(rule)).withColumn("failing_column", F.when(~F.col("_copy"), column))
    if contract.key:
        # Rejected rows don't stand for their key: each is its own group, so those of a common or blank key don't meet.
        apart = F.when(F.col("rule").isNotNull(), F.struct("_source_file", "_source_row"))
        again = Window.partitionBy(*contract.key, apart).orderBy("_source_file", "_source_row")
        repeat = F.col("rule").isNull() & (F.row_number().over(again) > 1)
        marked = marked.withColumn("_repeat", repeat).withColumn("rule", F.when(F.col("_repeat"), "ST-08").otherwise(F.col("rule"))).withColumn("failing_column", F.when(F.col("_repeat"), contract.key[0]).otherwise(F.col("failing_column"))).drop("_repeat")
    return marked.drop("_copy")


def staged(judged: DataFrame, contract: TableContract) -> DataFrame:
    """Rows that no rule rejects, typed; blanks are null."""

    def typed(c) -> Column:
        cell = F.nullif(F.col(c.name), F.lit(""))
        if c.type == "date":
            return parse_date(cell, list(c.formats))
        return cell if c.type == "text" else coerce_number(cell).try_cast(TYPES[c.type])

    return judged.filter("rule is null").select(*(typed(c).alias(c.name) for c in contract.columns), "_source_file", "_source_row")


def quarantine(judged: DataFrame) -> DataFrame:
    """Rejected rows: rule, failing column, its value as received, and the whole row as JSON."""
    fields = judged.schema["original"].dataType.names
    value = reduce(lambda out, n: F.when(F.col("failing_column") == n, F.col(f"original.{n}")).otherwise(out), fields, F.lit(None).cast("string"))
    return judged.filter("rule is not null").select("_source_file", "_source_row", "rule", "failing_column", value.alias("received_value"), F.to_json("original").alias("record"), F.lit("open").alias("status"))


def register(quarantined: DataFrame, contract: TableContract, layer: str = "staging") -> DataFrame:
    """Quarantined rows under ids Q000001 and so on, by file and line, with the layer, system and table that rejected them."""
    named = quarantined.select(F.lit(layer).alias("layer"), F.lit(contract.system).alias("system"), F.lit(contract.table).alias("table"), "*")
    return identified(named, ["_source_file", "_source_row"], "Q", 6, "quarantine_id")


def lineage(judged: DataFrame) -> DataFrame:
    """One row per rule: rows_in = rows_out + rows_rejected, and each rule's rows_in is the rows_out before it."""
    counts = judged.groupBy("rule").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    steps = judged.sparkSession.range(1).select(F.explode(F.array(*(F.struct(F.lit(i).alias("step"), F.lit(r).alias("rule"), F.lit(t).alias("rule_text")) for i, (r, t) in enumerate(RULES.items(), 1)))).alias("s")).select("s.*")
    rejected = steps.join(F.broadcast(counts), "rule", "left").withColumn("rows_rejected", F.coalesce("n", F.lit(0))).crossJoin(F.broadcast(total))
    upto = F.sum("rows_rejected").over(Window.orderBy("step"))  # one row per rule
    return rejected.select("step", "rule", "rule_text", (F.col("total") - upto + F.col("rows_rejected")).alias("rows_in"), (F.col("total") - upto).alias("rows_out"), "rows_rejected")


def assert_balanced(received: int, kept: int, rejected: int) -> None:
    if received != kept + rejected:
        raise AssertionError(f"{received} rows received, {kept} staged and {rejected} quarantined")


def marked_extract(raw: DataFrame, judged: DataFrame) -> DataFrame:
    """``raw`` with the rule and column that reject a row (null: it was staged), found by file and line."""
    verdicts = judged.filter("rule is not null").select("_source_file", "_source_row", "rule", "failing_column")
    return raw.join(verdicts, ["_source_file", "_source_row"], "left")
