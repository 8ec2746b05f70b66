"""The data quality engine: declared rules, one relation each, scored together in one job."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.logger import PySparkLogger
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import stored
from .numbering import numbered

#: Weights of severities. Fixed values.
SEVERITY = {"critical": 8, "high": 4, "medium": 2, "low": 1}
DIMENSIONS = ("completeness", "validity", "uniqueness", "consistency", "timeliness", "accuracy", "integrity")


@dataclass(frozen=True)
class Rule:
    """``check`` gives (record_key, passed, observed) for each record; SQL text with ${parameters}, or a function of (spark, parameters)."""

    id: str
    name: str
    dimension: str
    severity: str
    system: str
    owner: str
    threshold: float
    check: str | Callable[[SparkSession, dict], DataFrame]
    action: str = ""
    covers: tuple[int, ...] = ()


def validate(rules: list[Rule]) -> None:
    """Raises with all problems at once."""
    wrong = [f"{r.id}: severity {r.severity}" for r in rules if r.severity not in SEVERITY]
    wrong += [f"{r.id}: dimension {r.dimension}" for r in rules if r.dimension not in DIMENSIONS]
    wrong += [f"{r.id}: threshold {r.threshold}" for r in rules if not 0 < r.threshold <= 1]
    wrong += [f"{r.id}: no {f}" for r in rules for f in ("id", "name", "system", "owner", "check") if not getattr(r, f)]
    wrong += [f"{i}: used twice" for i in sorted({r.id for r in rules if sum(r.id == x.id for x in rules) > 1})]
    if wrong:
        raise ValueError("; ".join(wrong))


def from_yaml(config: dict, functions: dict[str, Callable] | None = None) -> list[Rule]:
    rules = [Rule(r["id"], r["name"], r["dimension"], r["severity"], r["system_of_record"], r["owner"], float(r["threshold"]), r["check"].get("sql") or (functions or {})[r["check"]["python"]], r.get("corrective_action", ""), tuple(r.get("covers_defects", ()))) for r in config["rules"]]
    validate(rules)
    return rules


class RowCheck(str):
    """A check of each row of a table alone, as SQL text; rules of one table are evaluated in one scan of it."""

    def __new__(cls, table: str, key: str, test: str, observed: str = "NULL"):
        self = super().__new__(cls, f"SELECT {key} AS record_key, {test} AS passed, CAST({observed} AS STRING) AS observed FROM {table}")
        self.table, self.key, self.test, self.observed = table, key, test, observed
        return self

    def given(self, parameters: dict) -> RowCheck:
        return RowCheck(*(substituted(x, parameters) for x in (self.table, self.key, self.test, self.observed)))


class GroupCheck(str):
    """A check of each group of a table's rows, as SQL text; rules of one table and one grouping are evaluated in one aggregation."""

    def __new__(cls, table: str, keys: tuple[str, ...], test: str, observed: str):
        key = f"concat_ws('/', {', '.join(keys)})" if len(keys) > 1 else keys[0]
        self = super().__new__(cls, f"SELECT {key} AS record_key, {test} AS passed, {observed} AS observed FROM {table} GROUP BY {', '.join(keys)}")
        self.table, self.keys, self.key, self.test, self.observed = table, keys, key, test, observed
        return self

    def given(self, parameters: dict) -> GroupCheck:
        return GroupCheck(substituted(self.table, parameters), self.keys, substituted(self.test, parameters), substituted(self.observed, parameters))


def not_null(table: str, key: str, column: str) -> RowCheck:
    return RowCheck(table, key, f"{column} IS NOT NULL", column)


def predicate(table: str, key: str, test: str, observed: str = "NULL") -> RowCheck:
    return RowCheck(table, key, test, observed)


def exists_in(child: str, key: str, column: str, parent: str, parent_column: str) -> str:
    return f"SELECT c.{key} AS record_key, p.k IS NOT NULL AS passed, CAST(c.{column} AS STRING) AS observed FROM {child} c LEFT JOIN (SELECT DISTINCT {parent_column} AS k FROM {parent}) p ON c.{column} = p.k"


def one_value(table: str, key: str, column: str) -> GroupCheck:
    """Every key has one value of a column, nulls apart; observed lists what was seen."""
    return GroupCheck(table, (key,), f"count(DISTINCT {column}) <= 1", f"array_join(array_sort(collect_set(CAST({column} AS STRING))), ', ')")


def unique(table: str, *keys: str) -> GroupCheck:
    """Every key stands once."""
    return GroupCheck(table, keys, "count(*) = 1", "CAST(count(*) AS STRING)")


def by_kind(table: str, key: str, kind: str, column: str, allowed: dict[str, tuple[str, ...]], otherwise: tuple[str, ...]) -> RowCheck:
    """A column's values are those that the row's kind allows."""
    listed = lambda values: f"{column} IN ({', '.join(repr(v) for v in values)})"
    cases = " ".join(f"WHEN {kind} = {k!r} THEN {listed(v)}" for k, v in allowed.items())
    return RowCheck(table, key, f"CASE {cases} ELSE {listed(otherwise)} END", f"concat({kind}, ' in ', {column})")


def in_order(table: str, key: str, first: str, last: str) -> RowCheck:
    """One date isn't after another; passes where either is missing."""
    return RowCheck(table, key, f"coalesce({first} <= {last}, true)", f"concat({first}, ' to ', {last})")


def has_child(parent: str, key: str, child: str, child_key: str, where: str = "true") -> str:
    """A parent that ``where`` holds for has a child."""
    return f"SELECT p.{key} AS record_key, EXISTS (SELECT 1 FROM {child} c WHERE c.{child_key} = p.{key}) AS passed, NULL AS observed FROM {parent} p WHERE {where}"


def in_sequence(parent: str, key: str, own: tuple[str, ...], children: tuple[tuple[str, str, str], ...]) -> str:
    """The parent's own dates rise, and then the first dates of its children, each a table, its key and its date; what is missing is skipped with what is compared to it."""
    joined = " ".join(f"LEFT JOIN (SELECT {k} AS k, min({at}) AS at FROM {t} WHERE {k} IS NOT NULL GROUP BY {k}) c{i} ON c{i}.k = p.{key}" for i, (t, k, at) in enumerate(children))
    dates = [f"p.{c}" for c in own] + [f"c{i}.at" for i in range(len(children))]
    test = " AND ".join(f"coalesce({a} <= {b}, true)" for a, b in zip(dates, dates[1:], strict=False))
    told = ", ".join(f"coalesce(date_format({d}, 'dd/MM/yyyy'), '-')" for d in dates)
    return f"SELECT p.{key} AS record_key, {test} AS passed, concat_ws(', ', {told}) AS observed FROM {parent} p {joined}"


def recorded_as(table: str, key: str, by: dict[str, str], xref: str, method: str, accepted: tuple[str, ...], observed: str) -> str:
    """A record's form, found in a crosswalk by all of ``by`` (column to column, nulls equal), was resolved by an accepted method."""
    same = " AND ".join(f"x.{theirs} IS NOT DISTINCT FROM t.{ours}" for ours, theirs in by.items())
    return f"SELECT {key} AS record_key, x.{method} IN ({', '.join(map(repr, accepted))}) AS passed, CAST({observed} AS STRING) AS observed FROM {table} t JOIN {xref} x ON {same}"


def one_code(xref: str, code: str, entity: str, of: str, suspects: str = "SELECT NULL AS code WHERE false") -> str:
    """An entity has one code of the rows that ``of`` holds for, and none that ``suspects`` (SQL giving code) names as another's."""
    return (
        f"SELECT x.{code} AS record_key, n.codes <= 1 AND s.code IS NULL AS passed, CAST(n.codes AS STRING) AS observed FROM {xref} x "
        f"JOIN (SELECT {entity} AS e, count(*) AS codes FROM {xref} WHERE {of} GROUP BY {entity}) n ON n.e = x.{entity} LEFT JOIN (SELECT DISTINCT code FROM ({suspects})) s ON s.code = x.{code} WHERE {of}"
    )


def not_quarantined(tables: tuple[str, ...], quarantine: str, rules: tuple[str, ...]) -> str:
    """No row as received was rejected by one of the rules; records carry their file and line."""
    rows = " UNION ALL ".join(f"SELECT _source_file, _source_row FROM {t}" for t in tables)
    listed = ", ".join(map(repr, rules))
    return (
        f"SELECT concat(r._source_file, ':', r._source_row) AS record_key, q.rule IS NULL AS passed, concat_ws(' ', q.rule, q.failing_column, q.received_value) AS observed, r._source_file AS source_file, r._source_row AS source_row "
        f"FROM ({rows}) r LEFT JOIN (SELECT _source_file, _source_row, rule, failing_column, received_value FROM {quarantine} WHERE rule IN ({listed})) q ON q._source_file = r._source_file AND q._source_row = r._source_row"
    )


def agrees(left: str, key: str, value: str, right: str, right_key: str, right_value: str, tolerance: float) -> str:
    """A figure agrees with the sum of its parts, within a share of it; a record without parts fails."""
    return (
        f"SELECT l.{key} AS record_key, abs(CAST(l.{value} AS DOUBLE) - r.s) <= {tolerance}D * abs(r.s) AS passed, CAST(round(CAST(l.{value} AS DOUBLE) - r.s, 2) AS STRING) AS observed "
        f"FROM {left} l LEFT JOIN (SELECT {right_key} AS k, CAST(sum(CAST({right_value} AS DECIMAL(18,2))) AS DOUBLE) AS s FROM {right} GROUP BY {right_key}) r ON l.{key} = r.k"
    )


def none_after(parent: str, key: str, closed: str, child: str, child_key: str, at: str) -> str:
    """No child is dated after its parent closed; a parent without children, or still open, passes."""
    return f"SELECT p.{key} AS record_key, coalesce(max(c.{at}) <= p.{closed}, true) AS passed, CAST(max(c.{at}) AS STRING) AS observed FROM {parent} p LEFT JOIN {child} c ON c.{child_key} = p.{key} GROUP BY p.{key}, p.{closed}"


def both_ways(left: str, left_key: str, right: str, right_key: str) -> str:
    """Keys of either table stand in the other; observed names the side that has it."""
    return (
        f"SELECT coalesce(l.k, r.k) AS record_key, l.k IS NOT NULL AND r.k IS NOT NULL AS passed, CASE WHEN r.k IS NULL THEN '{left} only' WHEN l.k IS NULL THEN '{right} only' END AS observed "
        f"FROM (SELECT DISTINCT {left_key} AS k FROM {left} WHERE {left_key} IS NOT NULL) l FULL JOIN (SELECT DISTINCT {right_key} AS k FROM {right} WHERE {right_key} IS NOT NULL) r ON l.k = r.k"
    )


def all_of(*checks: str) -> str:
    """The records of several checks under one rule."""
    return " UNION ALL ".join(f"SELECT CAST(record_key AS STRING) AS record_key, passed, CAST(observed AS STRING) AS observed FROM ({c})" for c in checks)


def within(table: str, key: str, value: str, target: str, tolerance: str) -> RowCheck:
    return predicate(table, key, f"abs({value} - {target}) <= ({tolerance}) * abs({target})", f"{value} - {target}")


def substituted(sql: str, parameters: dict) -> str:
    unknown = set(re.findall(r"\$\{(\w+)\}", sql)) - set(parameters)
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    return re.sub(r"\$\{(\w+)\}", lambda m: str(parameters[m[1]]), sql)


@dataclass(frozen=True)
class Evaluation:
    checks: DataFrame  # rule_id, record_key, passed, observed, source_file, source_row; read again from the tables when used
    failing: DataFrame  # those that fail, stored
    results: DataFrame
    errors: dict[str, str]


RECORD = "rule_id string, record_key string, passed boolean, observed string, source_file string, source_row int"


def _record(rule: str, key: Column, passed: Column, observed: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule_id"), key.cast("string").alias("record_key"), F.coalesce(passed, F.lit(False)).alias("passed"), observed.cast("string").alias("observed"))


def _lines(df: DataFrame, file: str, row: str) -> tuple[Column, Column]:
    """A record's file and line, null where the table doesn't say."""
    has = lambda c: F.col(c) if c in df.columns else F.lit(None)
    return has(file).cast("string").alias("source_file"), has(row).cast("int").alias("source_row")


def _alone(spark: SparkSession, rule: Rule, parameters: dict) -> DataFrame:
    if isinstance(rule.check, RowCheck | GroupCheck):
        return fused(spark, [rule], parameters)[0]
    df = rule.check(spark, parameters) if callable(rule.check) else spark.sql(substituted(rule.check, parameters))
    record = _record(rule.id, F.col("record_key"), F.col("passed"), F.col("observed"))
    return df.select(record.alias("r"), *_lines(df, "source_file", "source_row")).select("r.*", "source_file", "source_row")


def fused(spark: SparkSession, rules: list[Rule], parameters: dict) -> list[DataFrame]:
    """The records of rules that can be analysed: one scan for all row checks of a table, one aggregation for all group checks of a grouping, one query for each other rule."""
    return [df for _, df in _fused(spark, rules, parameters)]


def _fused(spark: SparkSession, rules: list[Rule], parameters: dict) -> list[tuple[list[Rule], DataFrame]]:
    rows, groups, out = {}, {}, []
    for r in rules:
        if isinstance(r.check, RowCheck):
            check = r.check.given(parameters)
            rows.setdefault(check.table, []).append((r, _record(r.id, F.expr(check.key), F.expr(check.test), F.expr(check.observed))))
        elif isinstance(r.check, GroupCheck):
            check = r.check.given(parameters)
            groups.setdefault((check.table, check.keys), []).append((r, check))
        else:
            out.append(([r], _alone(spark, r, parameters)))
    for table, checks in rows.items():
        df = spark.sql(f"SELECT * FROM {table}")
        records = [record for _, record in checks]
        out.append(([r for r, _ in checks], df.select(F.explode(F.array(*records)).alias("r"), *_lines(df, "_source_file", "_source_row")).select("r.*", "source_file", "source_row")))
    for (table, keys), checks in groups.items():
        once = spark.sql(f"SELECT * FROM {table}").groupBy(*map(F.expr, keys)).agg(*(F.struct(F.expr(c.test).alias("passed"), F.expr(c.observed).alias("observed")).alias(f"_{i}") for i, (_, c) in enumerate(checks)))
        records = [_record(r.id, F.expr(c.key), F.col(f"_{i}.passed"), F.col(f"_{i}.observed")) for i, (r, c) in enumerate(checks)]
        out.append(([r for r, _ in checks], once.select(F.explode(F.array(*records)).alias("r")).select("r.*", F.lit(None).cast("string").alias("source_file"), F.lit(None).cast("int").alias("source_row"))))
    return out


def _tried(rules: list[Rule], records: DataFrame) -> tuple[DataFrame, list[tuple[str, int, int]]]:
    """The records that fail, stored, and how many of each rule there are and fail, counted as they go by."""
    seen = Observation()
    own = lambda r: F.col("rule_id") == r.id
    counts = [F.count_if(test).alias(f"{name}_{i}") for i, r in enumerate(rules) for name, test in (("checked", own(r)), ("failed", own(r) & ~F.col("passed")))]
    failing = stored(records.observe(seen, *counts).filter(~F.col("passed")))
    return failing, [(r.id, seen.get[f"checked_{i}"], seen.get[f"failed_{i}"]) for i, r in enumerate(rules)]


def evaluate(spark: SparkSession, rules: list[Rule], parameters: dict | None = None) -> Evaluation:
    """All rules' records, tagged, and one row of results for each rule; a rule that fails to analyse is an error and not scored.

    pass_rate is 1 where nothing was checked; score = min(1, pass_rate / threshold); a null ``passed`` fails. Each query of
    fused() runs once and on its own: records that pass are counted, those that fail are stored, so that the disk holds these
    and the shuffles of one query at a time. If a query breaks, for a cast that breaks on some row, each of its rules is tried
    alone and only those that break are errors.
    """
    given, sound, errors = parameters or {}, [], {}
    log = PySparkLogger.getLogger("SQLQueryContextLogger")  # which would write the stack of every rule that breaks
    level = log.level
    log.setLevel(logging.CRITICAL + 1)
    none, checks, failing, counts = spark.createDataFrame([], RECORD), [], [], []
    try:
        for r in rules:
            try:
                _alone(spark, r, given)
                sound.append(r)
            except (AnalysisException, ValueError) as e:
                errors[r.id] = str(e).splitlines()[0]
        waiting = _fused(spark, sound, given)
        while waiting:
            own, records = waiting.pop(0)
            try:
                failed, counted = _tried(own, records)
            except (PySparkException, Py4JJavaError) as e:  # what a rule's rows raise
                if len(own) > 1:
                    waiting += [([r], _alone(spark, r, given)) for r in own]
                else:
                    errors[own[0].id] = str(e).splitlines()[0]
                continue
            checks.append(records)
            failing.append(failed)
            counts += counted
    finally:
        log.setLevel(level)
    listed = spark.createDataFrame([(r.id, r.name, r.dimension, r.severity, SEVERITY[r.severity], r.system, r.owner, float(r.threshold), "error" if r.id in errors else "ok") for r in rules], "rule_id string, name string, dimension string, severity string, weight int, system string, owner string, threshold double, status string")
    counted = spark.createDataFrame(counts, "rule_id string, checked long, failed long")
    rate = F.when(F.col("checked") > 0, 1 - F.col("failed").cast("double") / F.col("checked")).otherwise(1.0)
    joined = listed.join(F.broadcast(counted), "rule_id", "left").fillna(0, ["checked", "failed"]).withColumn("pass_rate", rate)
    ok = F.col("status") == "ok"
    results = joined.withColumn("met", F.when(ok, F.col("pass_rate") >= F.col("threshold"))).withColumn("score", F.when(ok, F.least(F.lit(1.0), F.col("pass_rate") / F.col("threshold"))))
    return Evaluation(*(reduce(DataFrame.unionAll, x, none) for x in (checks, failing)), results, errors)


def index(results: DataFrame, by: list[str] = ()) -> DataFrame:
    """The severity-weighted index, 0 to 100, of all scored rules or of each group, with its counts."""
    scored = results.filter("status = 'ok'")
    worth: Column = 100 * F.sum(F.col("weight") * F.col("score")) / F.sum("weight")
    return scored.groupBy(*by).agg(F.count("*").alias("n_rules"), F.count_if("met").alias("n_met"), F.count_if((F.col("severity") == "critical") & ~F.col("met")).alias("critical_breaches"), F.sum("checked").alias("checked"), F.sum("failed").alias("failed"), worth.alias("index"))


def exceptions(evaluation: Evaluation) -> DataFrame:
    """Failing records with the file and line they come from, where that is known, and their rule's owner and severity, numbered within each rule by key."""
    failing = numbered(evaluation.failing.drop("passed"), ["record_key", "observed"], group=["rule_id"])
    return failing.join(F.broadcast(evaluation.results.select("rule_id", "severity", "owner")), "rule_id").select("rule_id", "place", "record_key", "observed", "source_file", "source_row", "severity", "owner")


def fingerprint(hashes: DataFrame, path: str = "path", digest: str = "sha256") -> str:
    """One SHA-256 for a set of files, whatever order they are listed in; hashes has a row for each file."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(path, digest))), lambda f: f[digest]), "")
    return hashes.agg(F.sha2(joined, 256).alias("found")).first()["found"]


def defect_coverage(spark: SparkSession, rules: list[Rule], defects: list[int], results: DataFrame) -> DataFrame:
    """Each known defect with the rules that cover it and the records they fail; uncovered defects have none."""
    covers = spark.createDataFrame([(d, r.id) for r in rules for d in r.covers] or [], "defect int, rule_id string")
    known = spark.createDataFrame([(d,) for d in defects], "defect int")
    failed = results.filter("status = 'ok'").select("rule_id", "failed")
    joined = known.join(F.broadcast(covers), "defect", "left").join(failed, "rule_id", "left")
    return joined.groupBy("defect").agg(F.array_join(F.array_sort(F.collect_set("rule_id")), ", ").alias("rules"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"))


def trend(history: DataFrame, order: str = "run") -> DataFrame:
    """The index of each run of ``history`` (results with a run column) and its change since the run before."""
    by_run = index(history, [order])
    before = F.lag("index").over(Window.orderBy(order))  # one row a run
    return by_run.withColumn("change", F.col("index") - before)
