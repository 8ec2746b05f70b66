"""Who owns what, what every rule did, what is unresolved, and how material is used, over the TPC-H-like tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import governance, provenance, staging, yields
from ..operators import quality as dq
from .marts import kpi_scorecard
from .quality import _CHECKS, evaluated
from .registry import ORACLES, query, read
from .relational import number_tokens_query
from .staging import CONTRACT, raw

_EVERY = _CHECKS + ", listed AS (SELECT owner, severity, system, met FROM scored UNION ALL SELECT 'Quality Manager', 'low', 'labels', NULL)"


@query("ownership_matrix", _EVERY + f"""
, r AS (SELECT owner, count(*) AS rules, count(*) FILTER (WHERE severity = 'critical') AS critical_rules, count(*) FILTER (WHERE NOT met) AS rules_breaching FROM listed GROUP BY 1),
e AS (SELECT owner, count(*) AS open_exceptions FROM checks JOIN rules USING (rule_id) WHERE NOT passed GROUP BY 1),
k AS (SELECT owner, count(*) AS kpis_owned, count(*) FILTER (WHERE status = 'off target') AS kpis_off_target FROM ({ORACLES["kpi_scorecard"]}) GROUP BY 1)
SELECT owner, rules, critical_rules, rules_breaching, coalesce(open_exceptions, 0) AS open_exceptions, coalesce(kpis_owned, 0) AS kpis_owned, coalesce(kpis_off_target, 0) AS kpis_off_target FROM r LEFT JOIN e USING (owner) LEFT JOIN k USING (owner)""")
def ownership_matrix(spark, sf):
    found = evaluated(spark, sf)
    return governance.ownership(found.results, dq.exceptions(found), kpi_scorecard(spark, sf))


_SYSTEMS = ("orders", "customer", "lineitem", "labels")


@query("rules_by_system", _EVERY + f"SELECT owner, {', '.join(f'count(*) FILTER (WHERE system = {s!r}) AS {s}' for s in _SYSTEMS)} FROM listed GROUP BY owner")
def rules_by_system(spark, sf):
    return governance.rules_by_system(evaluated(spark, sf).results, list(_SYSTEMS))


@query("dq_exceptions_chosen", "SELECT * FROM (" + ORACLES["dq_exceptions"] + ") WHERE owner = 'Production Controller' AND severity IN ('critical', 'high')")
def dq_exceptions_chosen(spark, sf):
    return governance.chosen(dq.exceptions(evaluated(spark, sf)), ("Production Controller",), ("critical", "high")).drop("source_file", "source_row")


_NAMED = ", ".join(f"('{rule}', '{governance.LAYERS[rule.split('-')[0]]}')" for rule in sorted(governance.RAW_RULES | governance.RULES | governance.LATER_RULES))


@query("rule_activity", f"""
WITH named AS (SELECT * FROM (VALUES {_NAMED}) AS v(rule, layer)), sizes AS (SELECT (SELECT count(*) FROM lineitem) AS a, (SELECT count(*) FROM lineitem JOIN part ON l_partkey = p_partkey) AS b),
ran AS (SELECT rule, rows_in, rows_out, rows_rejected FROM ({ORACLES["staging_lineage"]}) UNION ALL SELECT 'CO-05', a, b, a - b FROM sizes)
SELECT rule, layer, rows_in, rows_out, rows_rejected FROM named LEFT JOIN ran USING (rule)""")
def rule_activity(spark, sf):
    """The staging rules' rows, and those of the join of lines to parts, under the ids of all rules."""
    lines = read(spark, sf, "lineitem").select("l_partkey")
    met = lines.join(read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey")
    ran = [staging.lineage(staging.judge(raw(spark, sf), CONTRACT)), governance.lineage_of("CO-05", lines, met)]
    return governance.activity(governance.catalogue(spark), ran).drop("rule_text")


#: Lines name their order in two spellings, and every seventh order isn't held. SQL that both engines read.
_FORMS = """
SELECT l_orderkey AS parsed_number, CASE WHEN l_linenumber % 2 = 0 THEN 'WO ' || CAST(l_orderkey AS {text}) ELSE CAST(l_orderkey AS {text}) END AS source_value, count(*) AS row_count,
CASE WHEN l_linenumber % 2 = 0 THEN 'wo_prefix' ELSE 'bare_number' END AS matched_on FROM lineitem GROUP BY 1, 2, 4"""


@query("unresolved_references", f"""
WITH forms AS ({_FORMS.format(text="VARCHAR")}), held AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0)
SELECT parsed_number, string_agg(source_value, ', ' ORDER BY source_value) AS written_as, CAST(sum(row_count) AS BIGINT) AS rows, min(matched_on) AS matched_on FROM forms LEFT JOIN held ON parsed_number = o_orderkey WHERE o_orderkey IS NULL GROUP BY 1""")
def unresolved_references(spark, sf):
    forms = spark.sql(_FORMS.format(text="STRING").replace("FROM lineitem", "FROM {lineitem}"), lineitem=read(spark, sf, "lineitem"))
    held = read(spark, sf, "orders").filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("wo_no"))
    return governance.unresolved(forms.join(held, F.col("parsed_number") == F.col("wo_no"), "left"))


#: A ledger of the figures in documents that lacks some, has some late and some twice. SQL that both engines read.
_LEDGER = """
SELECT doc_id, CASE WHEN place % 5 = 2 THEN place + 1000000 ELSE place END AS place, token AS text, 'e' || CAST(place AS {text}) AS origin FROM {tokens} WHERE place % 7 <> 3
UNION ALL SELECT doc_id, place + 2000000, token, 'again' FROM {tokens} WHERE place % 11 = 0"""


@query("figures_attributed", f"""
WITH tokens AS ({ORACLES["number_tokens"]}), t AS (SELECT *, lead(token) OVER (PARTITION BY doc_id ORDER BY place) AS after FROM tokens),
l AS (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY place) AS after FROM ({_LEDGER.format(text="VARCHAR", tokens="tokens")})),
tn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, token, after ORDER BY place) AS n FROM t), ln AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text, after ORDER BY place) AS n FROM l),
met AS (SELECT tn.doc_id, tn.place, token, origin, ln.place AS entry FROM tn LEFT JOIN ln ON tn.doc_id = ln.doc_id AND token = text AND tn.after IS NOT DISTINCT FROM ln.after AND tn.n = ln.n),
rest AS (SELECT doc_id, place, token, row_number() OVER (PARTITION BY doc_id, token ORDER BY place) AS n FROM met WHERE entry IS NULL),
spare AS (SELECT l.*, row_number() OVER (PARTITION BY l.doc_id, text ORDER BY l.place) AS n FROM l LEFT JOIN met ON met.doc_id = l.doc_id AND met.entry = l.place WHERE met.entry IS NULL)
SELECT doc_id, CAST(place AS INT) AS place, token, origin FROM met WHERE entry IS NOT NULL UNION ALL SELECT rest.doc_id, CAST(rest.place AS INT), token, origin FROM rest LEFT JOIN spare ON rest.doc_id = spare.doc_id AND token = text AND rest.n = spare.n""")
def figures_attributed(spark, sf):
    tokens = number_tokens_query(spark, sf)
    return provenance.attributed(tokens, spark.sql(_LEDGER.format(text="STRING", tokens="{tokens}"), tokens=tokens), "doc_id")


#: Lines as bills of material, some of them in pieces, in plates or longer than a bar; and as receipts by code. SQL that both engines read.
_SECTION = "CASE p_partkey % 5 WHEN 0 THEN 'UB' WHEN 1 THEN 'RHS' WHEN 2 THEN 'PLATE' WHEN 3 THEN 'UC' ELSE 'PFC' END AS section_type"
_BOM = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_SECTION}, CASE WHEN p_partkey % 5 = 4 OR l_linenumber % 6 = 0 THEN 'EA' ELSE 'M' END AS uom, CAST(l_quantity AS INT) AS qty, p_size * 300 AS length_mm,
CAST(l_quantity AS INT) * (5 + p_partkey % 40) AS kg, 12000 AS bar_length_mm FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey"""
_RECEIPTS = "SELECT 'P-' || CAST(l_partkey AS {text}) AS material_code, CASE l_linenumber % 3 WHEN 0 THEN 'KG' WHEN 1 THEN 'M' ELSE 'EA' END AS uom, CAST(l_quantity AS INT) AS qty FROM {lineitem} WHERE l_returnflag <> 'R'"
_XREF = """
SELECT 'P-' || CAST(p_partkey AS {text}) AS source_code, CASE WHEN p_partkey % 3 > 0 THEN 'C' || CAST(p_partkey AS {text}) END AS canonical_code, CASE WHEN p_partkey % 2 = 0 THEN 'C' || CAST(p_partkey AS {text}) END AS proposed_code,
'C' || CAST(p_partkey AS {text}) || ', C0' AS candidates FROM {part} WHERE p_partkey % 13 > 0"""
_GOLDEN = f"SELECT 'C' || CAST(p_partkey AS {{text}}) AS canonical_code, {_SECTION}, 5 + p_partkey % 40 AS mass, 2 + p_partkey % 9 AS kg_per_ea FROM {{part}} WHERE p_partkey % 5 > 0"
_FOR_DUCKDB = {"text": "VARCHAR", "lineitem": "lineitem", "part": "part"}
_CUT = f"""
WITH bom AS ({_BOM.format(**_FOR_DUCKDB)}), sized AS (SELECT *, CAST(round(CAST(qty * 1000 AS DOUBLE) / length_mm) AS BIGINT) AS pieces, CAST(floor(CAST(bar_length_mm AS DOUBLE) / length_mm) AS BIGINT) AS pieces_per_bar FROM bom
  WHERE uom = 'M' AND section_type <> 'PLATE' AND length_mm BETWEEN 1 AND bar_length_mm),
barred AS (SELECT *, CAST(ceil(CAST(pieces AS DOUBLE) / pieces_per_bar) AS BIGINT) AS bars FROM sized),
cut AS (SELECT *, CAST(pieces * length_mm AS DOUBLE) / 1000 AS used_m, CAST(bars * bar_length_mm AS DOUBLE) / 1000 AS bought_m, CAST(kg AS DOUBLE) AS used_kg, CAST(kg AS DOUBLE) * CAST(bars * bar_length_mm AS DOUBLE) / nullif(CAST(pieces * length_mm AS DOUBLE), 0) AS bought_kg FROM barred)
"""


def _sql(spark, sf, text):
    return spark.sql(text.replace("{text}", "STRING"), **{t: read(spark, sf, t) for t in ("lineitem", "part") if f"{{{t}}}" in text})


@query("material_yield_lines", _CUT + "SELECT *, bought_m - used_m AS offcut_m FROM cut")
def material_yield_lines(spark, sf):
    return yields.cut_lines(_sql(spark, sf, _BOM))


@query("material_yield_by_section", _CUT + f"""
, r AS ({_RECEIPTS.format(**_FOR_DUCKDB)}), x AS ({_XREF.format(**_FOR_DUCKDB)}), g AS ({_GOLDEN.format(**_FOR_DUCKDB)}),
c AS (SELECT section_type, count(*) AS bom_lines, CAST(sum(CAST(used_kg AS DECIMAL(28,3))) AS DOUBLE) AS used, CAST(sum(CAST(bought_kg AS DECIMAL(28,3))) AS DOUBLE) AS bought FROM cut GROUP BY 1),
i AS (SELECT section_type, CAST(sum(kg) AS DOUBLE) AS issued FROM bom GROUP BY 1),
a AS (SELECT section_type, CAST(sum(CASE uom WHEN 'KG' THEN qty WHEN 'M' THEN qty * mass WHEN 'EA' THEN qty * kg_per_ea END) AS DOUBLE) AS arrived FROM r JOIN x ON source_code = material_code JOIN g ON g.canonical_code = coalesce(x.canonical_code, proposed_code, split_part(candidates, ', ', 1)) GROUP BY 1)
SELECT section_type, bom_lines, round(used) AS cut_used_kg, round(bought) AS cut_bought_kg, round(100 * used / bought, 1) AS cut_yield_pct, round(100 - 100 * used / bought, 1) AS offcut_waste_pct, round(issued) AS issued_kg, round(arrived) AS received_kg, round(arrived / issued, 2) AS received_to_issued
FROM i LEFT JOIN c USING (section_type) LEFT JOIN a USING (section_type)""")
def material_yield_by_section(spark, sf):
    received = yields.received_weight(*(_sql(spark, sf, text) for text in (_RECEIPTS, _XREF, _GOLDEN)))
    return yields.by_section(_sql(spark, sf, _BOM), received)
