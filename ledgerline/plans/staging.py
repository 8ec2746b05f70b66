"""Staging, quarantine, profiling and conformance, over extracts of the events and orders spoilt by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import job_reference, works_order_form
from ..operators import profiling, runs, staging
from ..sources.contracts import Column, TableContract
from .registry import query, read

CONTRACT = TableContract("shop_floor", "readings", (
    Column("reading_id", "integer", required=True, key=True), Column("taken_on", "date", required=True, formats=("%Y-%m-%d", "%d/%m/%Y")),
    Column("operator", "text", required=True), Column("kind", "text", domain=("click", "view", "purchase", "signup", "login", "logout", "search", "cart", "share")), Column("amount", "decimal"),
))

#: The extract as SQL that both engines read: texts, with spoilt cells, exact duplicates and repeated keys by modulus.
_RAW = """
SELECT CAST(CASE WHEN c = 2 THEN event_id - 1 ELSE event_id END AS {text}) AS reading_id,
CASE WHEN event_id % 37 = 0 THEN '31/02/2025' WHEN event_id % 5 = 0 THEN '07/03/2024' ELSE '2024-03-' || lpad(CAST(1 + event_id % 28 AS {text}), 2, '0') END AS taken_on,
CASE WHEN event_id % 29 = 0 THEN '  ' ELSE ' op' || CAST(user_id AS {text}) || CASE WHEN event_id % 3 = 0 THEN '  ' ELSE '' END END AS operator,
CASE WHEN event_id % 31 = 0 THEN 'UNKNOWN' ELSE event_type END AS kind,
CASE WHEN event_id % 23 = 0 THEN '7,5' WHEN event_id % 19 = 0 THEN '1,250.50' WHEN event_id % 13 = 0 THEN '' ELSE CAST(event_id % 1000 AS {text}) || '.25' END AS amount,
CAST('readings.csv' AS {text}) AS _source_file, CAST(event_id * 10 + c AS INT) AS _source_row
FROM (SELECT event_id, user_id, event_type, 0 AS c FROM events UNION ALL SELECT event_id, user_id, event_type, 1 FROM events WHERE event_id % 41 = 0 UNION ALL SELECT event_id, user_id, event_type, 2 FROM events WHERE event_id % 43 = 0 AND event_id > 0) e"""


def raw(spark, sf):
    return spark.sql(_RAW.format(text="STRING").replace("FROM events", "FROM {events}"), events=read(spark, sf, "events"))


_DOMAIN = ", ".join(f"'{x}'" for x in CONTRACT.columns[3].domain)
_JUDGED = f"""
WITH raw AS ({_RAW.format(text='VARCHAR')}),
cells AS (SELECT reading_id, taken_on, trim(operator) AS operator, kind, amount, operator AS received_operator, _source_row FROM raw),
copies AS (SELECT *, row_number() OVER (PARTITION BY reading_id, taken_on, operator, kind, amount ORDER BY _source_row) > 1 AS copied FROM cells),
first AS (SELECT *, CASE WHEN copied THEN 'ST-02' WHEN operator = '' THEN 'ST-03' WHEN taken_on = '31/02/2025' THEN 'ST-04' WHEN amount = '7,5' THEN 'ST-05' WHEN kind NOT IN ({_DOMAIN}) THEN 'ST-07' END AS r FROM copies),
judged AS (SELECT *, CASE WHEN r IS NULL AND row_number() OVER (PARTITION BY reading_id, r IS NULL ORDER BY _source_row) > 1 THEN 'ST-08' ELSE r END AS rule FROM first)
"""


@query("staged_rows", _JUDGED + "SELECT CAST(reading_id AS INT) AS reading_id, CASE WHEN taken_on LIKE '%/%' THEN DATE '2024-03-07' ELSE CAST(taken_on AS DATE) END AS taken_on, operator, kind, CAST(nullif(replace(amount, ',', ''), '') AS DOUBLE) AS amount, _source_row FROM judged WHERE rule IS NULL")
def staged_rows(spark, sf):
    return staging.staged(staging.judge(raw(spark, sf), CONTRACT), CONTRACT).withColumn("amount", F.col("amount").cast("double")).drop("_source_file")


@query("quarantined_rows", _JUDGED + "SELECT _source_row, rule, CASE rule WHEN 'ST-03' THEN 'operator' WHEN 'ST-04' THEN 'taken_on' WHEN 'ST-05' THEN 'amount' WHEN 'ST-07' THEN 'kind' WHEN 'ST-08' THEN 'reading_id' END AS failing_column, CASE rule WHEN 'ST-03' THEN received_operator WHEN 'ST-04' THEN taken_on WHEN 'ST-05' THEN amount WHEN 'ST-07' THEN kind WHEN 'ST-08' THEN reading_id END AS received_value FROM judged WHERE rule IS NOT NULL")
def quarantined_rows(spark, sf):
    return staging.quarantine(staging.judge(raw(spark, sf), CONTRACT)).select("_source_row", "rule", "failing_column", "received_value")


@query("quarantine_records", _JUDGED + """
SELECT 'readings.csv' AS _source_file, _source_row, rule, CASE rule WHEN 'ST-03' THEN 'operator' WHEN 'ST-04' THEN 'taken_on' WHEN 'ST-05' THEN 'amount' WHEN 'ST-07' THEN 'kind' WHEN 'ST-08' THEN 'reading_id' END AS failing_column,
CASE rule WHEN 'ST-03' THEN received_operator WHEN 'ST-04' THEN taken_on WHEN 'ST-05' THEN amount WHEN 'ST-07' THEN kind WHEN 'ST-08' THEN reading_id END AS received_value,
'{"reading_id":"' || reading_id || '","taken_on":"' || taken_on || '","operator":"' || received_operator || '","kind":"' || kind || '","amount":"' || amount || '"}' AS record, 'open' AS status FROM judged WHERE rule IS NOT NULL""")
def quarantine_records(spark, sf):
    return staging.quarantine(staging.judge(raw(spark, sf), CONTRACT))


@query("staging_lineage", _JUDGED + """
, rules AS (SELECT * FROM (VALUES (1, 'ST-02'), (2, 'ST-03'), (3, 'ST-04'), (4, 'ST-05'), (5, 'ST-06'), (6, 'ST-07'), (7, 'ST-08')) AS v(step, rule)),
n AS (SELECT step, rules.rule, count(judged.rule) AS rows_rejected FROM rules LEFT JOIN judged ON rules.rule = judged.rule GROUP BY 1, 2)
SELECT step, rule, CAST((SELECT count(*) FROM judged) - sum(rows_rejected) OVER (ORDER BY step) + rows_rejected AS BIGINT) AS rows_in, CAST((SELECT count(*) FROM judged) - sum(rows_rejected) OVER (ORDER BY step) AS BIGINT) AS rows_out, rows_rejected FROM n""")
def staging_lineage(spark, sf):
    return staging.lineage(staging.judge(raw(spark, sf), CONTRACT)).drop("rule_text")


_PROFILED = ("reading_id", "taken_on", "operator", "amount")


@query("profile_columns", f"WITH raw AS ({_RAW.format(text='VARCHAR')}), " + """
cells AS (SELECT 1 AS ordinal, 'reading_id' AS column_name, reading_id AS v FROM raw UNION ALL SELECT 2, 'taken_on', taken_on FROM raw UNION ALL SELECT 3, 'operator', operator FROM raw UNION ALL SELECT 4, 'amount', amount FROM raw)
SELECT ordinal, column_name, count(*) AS n_rows, count(*) FILTER (WHERE trim(v) = '') AS blanks, count(DISTINCT v) AS distinct_values, count(*) FILTER (WHERE trim(v) <> v) AS padded,
CASE WHEN bool_and(regexp_matches(trim(v), '^[+-]?[0-9]+$')) FILTER (WHERE trim(v) <> '') THEN 'INTEGER' WHEN bool_and(regexp_matches(trim(v), '^[+-]?[0-9]+([.][0-9]+)?$')) FILTER (WHERE trim(v) <> '') THEN 'DECIMAL'
WHEN bool_and(v <> '31/02/2025' AND regexp_matches(v, '^[0-9]+[-/][0-9]+[-/][0-9]+$')) FILTER (WHERE trim(v) <> '') THEN 'DATE' ELSE 'TEXT' END AS inferred_type FROM cells GROUP BY 1, 2""")
def profile_columns(spark, sf):
    return profiling.profile_columns(raw(spark, sf), list(_PROFILED), ["%Y-%m-%d", "%d/%m/%Y"])


@query("profile_anomalies", f"WITH raw AS ({_RAW.format(text='VARCHAR')}), " + f"""
hits AS (SELECT 'operator' AS column_name, 'padding' AS anomaly, operator AS v, _source_row AS line FROM raw WHERE trim(operator) <> operator UNION ALL SELECT 'operator', 'blank in required', operator, _source_row FROM raw WHERE trim(operator) = ''
UNION ALL SELECT 'taken_on', 'unreadable date', taken_on, _source_row FROM raw WHERE taken_on = '31/02/2025' UNION ALL SELECT 'amount', 'number as text', amount, _source_row FROM raw WHERE amount = '1,250.50'
UNION ALL SELECT 'amount', 'not a number', amount, _source_row FROM raw WHERE amount = '7,5' UNION ALL SELECT 'kind', 'outside domain', kind, _source_row FROM raw WHERE kind NOT IN ({_DOMAIN})),
spelt AS (SELECT column_name, anomaly, v, count(*) AS n, min(line) AS line FROM hits GROUP BY 1, 2, 3)
SELECT column_name, anomaly, CAST(sum(n) AS BIGINT) AS affected, list(v ORDER BY line, v)[1:5] AS samples FROM spelt GROUP BY 1, 2""")
def profile_anomalies(spark, sf):
    return profiling.anomalies(raw(spark, sf), CONTRACT)


@query("case_variant_groups", "WITH v AS (SELECT CASE p_partkey % 3 WHEN 0 THEN upper(p_type) WHEN 1 THEN p_type ELSE ' ' || p_type END AS t FROM part) SELECT lower(regexp_replace(trim(t), '\\s+', ' ', 'g')) AS folded, string_agg(DISTINCT t, '|' ORDER BY t) AS spellings, count(DISTINCT t) AS n_spellings, count(*) AS affected FROM v GROUP BY 1 HAVING count(DISTINCT t) > 1")
def case_variant_groups(spark, sf):
    spelt = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_type")).when(F.col("p_partkey") % 3 == 1, F.col("p_type")).otherwise(F.concat(F.lit(" "), F.col("p_type")))
    return profiling.case_variants(read(spark, sf, "part").select(spelt.alias("t")), "t")


_FORMS = "CASE o_orderkey % 6 WHEN 0 THEN lpad(CAST(o_orderkey % 100000 AS {t}), 5, '0') WHEN 1 THEN 'WO ' || lpad(CAST(o_orderkey % 100000 AS {t}), 5, '0') WHEN 2 THEN lpad(CAST(o_orderkey % 100000 AS {t}), 5, '0') || ' (rev B)' WHEN 3 THEN 'see ' || lpad(CAST(o_orderkey % 100000 AS {t}), 5, '0') || '!' WHEN 4 THEN 'j24-' || CAST(o_orderkey % 1000 AS {t}) ELSE 'none' END"


@query("parse_reference_forms", f"""
WITH f AS (SELECT o_orderkey, o_orderkey % 6 AS k, {_FORMS.format(t='VARCHAR')} AS form FROM orders)
SELECT o_orderkey, CASE WHEN k <= 3 THEN CAST(o_orderkey % 100000 AS INT) END AS number, CASE WHEN k = 2 THEN 'B' END AS revision, CASE k WHEN 0 THEN 'bare_number' WHEN 1 THEN 'wo_prefix' WHEN 2 THEN 'revision_suffix' WHEN 3 THEN 'embedded_number' ELSE 'unparsed' END AS method,
CASE k WHEN 0 THEN 100 WHEN 1 THEN 99 WHEN 2 THEN 97 WHEN 3 THEN 85 ELSE 0 END AS score, CASE WHEN k = 4 THEN 'J-24-' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 4, '0') END AS job FROM f""")
def parse_reference_forms(spark, sf):
    formed = read(spark, sf, "orders").select("o_orderkey", F.expr(_FORMS.format(t="STRING")).alias("form"))
    job = F.when(F.col("form").startswith("j"), job_reference(F.col("form")))
    return formed.select("o_orderkey", works_order_form(F.col("form")).alias("w"), job.alias("job")).select("o_orderkey", "w.*", "job")


@query("marked_extract", _JUDGED + "SELECT _source_row, reading_id, kind, rule, CASE rule WHEN 'ST-03' THEN 'operator' WHEN 'ST-04' THEN 'taken_on' WHEN 'ST-05' THEN 'amount' WHEN 'ST-07' THEN 'kind' WHEN 'ST-08' THEN 'reading_id' END AS failing_column FROM judged")
def marked_extract(spark, sf):
    received = raw(spark, sf)
    return staging.marked_extract(received, staging.judge(received, CONTRACT)).select("_source_row", "reading_id", "kind", "rule", "failing_column")


@query("quarantine_summary", _JUDGED + "SELECT rule, count(*) AS n_rows FROM judged WHERE rule IS NOT NULL GROUP BY rule")
def quarantine_summary(spark, sf):
    return staging.quarantine(staging.judge(raw(spark, sf), CONTRACT)).groupBy("rule").agg(F.count("*").alias("n_rows"))


@query("quarantine_register", _JUDGED + "SELECT 'Q' || lpad(CAST(row_number() OVER (ORDER BY _source_row) AS VARCHAR), 6, '0') AS quarantine_id, 'staging' AS layer, 'shop_floor' AS system, 'readings' AS \"table\", _source_row, rule FROM judged WHERE rule IS NOT NULL")
def quarantine_register(spark, sf):
    rejected = staging.quarantine(staging.judge(raw(spark, sf), CONTRACT))
    return staging.register(rejected, CONTRACT).select("quarantine_id", "layer", "system", "table", "_source_row", "rule")


#: The extract dealt to four files, so that several are balanced.
_FILE = "'readings-' || CAST(_source_row % 4 AS {text}) || '.csv'"


@query("file_balance", _JUDGED + f"""
, f AS (SELECT {_FILE.format(text='VARCHAR')} AS _source_file, rule FROM judged)
SELECT _source_file, count(*) AS received, count(*) FILTER (WHERE rule IS NULL) AS staged, count(*) FILTER (WHERE rule IS NOT NULL) AS quarantined, count(*) FILTER (WHERE rule IS NULL) AS core, true AS balanced FROM f GROUP BY 1""")
def file_balance(spark, sf):
    named = F.expr(_FILE.format(text="STRING"))
    received = raw(spark, sf)
    judged = staging.judge(received, CONTRACT)  # judged as one extract, so that repeats are found across files
    lines = received.groupBy(named.alias("_source_file")).agg(F.count("*").alias("data_lines"))
    kept, rejected = (df.withColumn("_source_file", named) for df in (staging.staged(judged, CONTRACT), staging.quarantine(judged)))
    return runs.balance(lines, kept, rejected)


@query("table_profile", f"WITH raw AS ({_RAW.format(text='VARCHAR')}), " + """
g AS (SELECT reading_id, taken_on, operator, kind, amount, count(*) AS n, CAST(trim(operator) = '' AS INT) + CAST(amount = '' AS INT) AS blanks FROM raw GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, 5 AS n_columns, CAST(sum(n * blanks) AS BIGINT) AS blank_cells, CAST(sum(n) - count(*) AS BIGINT) AS exact_duplicates, count(*) - count(DISTINCT reading_id) AS duplicate_keys FROM g""")
def table_profile(spark, sf):
    return profiling.table_profile(raw(spark, sf), CONTRACT)


@query("mixed_date_formats", f"WITH raw AS ({_RAW.format(text='VARCHAR')}), " + """
n AS (SELECT count(*) FILTER (WHERE taken_on = '07/03/2024') AS a, count(*) FILTER (WHERE taken_on LIKE '2024-%') AS b FROM raw)
SELECT 'taken_on' AS column_name, '%Y-%m-%d ' || CAST(b AS VARCHAR) || ', %d/%m/%Y ' || CAST(a AS VARCHAR) AS formats, least(a, b) AS affected FROM n WHERE a > 0 AND b > 0""")
def mixed_date_formats(spark, sf):
    return profiling.mixed_date_formats(raw(spark, sf), CONTRACT)


@query("type_mismatches", f"WITH raw AS ({_RAW.format(text='VARCHAR')}) " + """
SELECT 'taken_on' AS column_name, 'date' AS declared, 'TEXT' AS inferred FROM raw WHERE taken_on = '31/02/2025' UNION SELECT 'amount', 'decimal', 'TEXT' FROM raw WHERE amount LIKE '%,%'""")
def type_mismatches(spark, sf):
    return profiling.mismatches(raw(spark, sf), CONTRACT)
