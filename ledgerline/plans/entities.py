"""Materials and parties: written forms resolved to codes, golden records, evidence for pairs, crosswalks and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import materials, parties
from ..operators.components import connected_components
from ..operators.matching import band, block_pairs
from .registry import query, read

#: Forms derived from part keys, in expressions that Spark and DuckDB share.
_LOW = "CASE {} WHEN 0 THEN '203x133x25UB' WHEN 1 THEN '20mm plate' WHEN 2 THEN '100x50x5RHS' ELSE '152x152x37 UC' END"
_BASE = "CASE d WHEN 0 THEN 'UB203X133X25' WHEN 1 THEN 'PLT20' WHEN 2 THEN 'RHS100X50X5' ELSE 'UC152X152X37' END"
_KEYED = "SELECT p_partkey AS k, p_partkey % 4 AS d, CASE WHEN p_partkey % 7 < 6 THEN p_partkey % 7 ELSE 6 + p_partkey % 3 END AS t, CASE WHEN p_partkey % 4 = 1 OR p_partkey % 5 >= 3 THEN 'S275JR' ELSE 'S355J2' END AS g FROM part"
_WRITTEN = f"""SELECT t, d, g, CASE t WHEN 0 THEN {_BASE} || '-' || g WHEN 1 THEN {_LOW.format("d")} || ' ' || g WHEN 4 THEN 'ITEM-' || CAST(k % 3 AS STRING) WHEN 6 THEN 'BOLT-M16' WHEN 7 THEN 'MISC' WHEN 8 THEN {_LOW.format("0")} ELSE {_LOW.format("d")} END AS code,
CASE WHEN t IN (3, 4) THEN {_LOW.format("d")} || ' ' || g WHEN t = 8 THEN {_LOW.format("3")} || ' ' || g END AS description, CASE WHEN t = 2 THEN g END AS grade,
CASE WHEN k % 11 = 0 THEN 'EA' ELSE 'M' END AS uom, CASE d WHEN 0 THEN CAST(25 AS DOUBLE) WHEN 3 THEN CAST(40 AS DOUBLE) END AS unit_weight FROM ({_KEYED}) x"""

_RESOLVED = f"""
WITH written AS ({_WRITTEN.replace("AS STRING", "AS VARCHAR")}),
tidy AS (SELECT code, description, grade, uom, t, CASE WHEN t = 8 THEN 0 WHEN t < 6 THEN d END AS d, CASE WHEN t IN (5, 6, 7) THEN NULL ELSE g END AS g FROM written),
forms AS (SELECT code, description, grade, t, d, g, {_BASE} || '-' || g AS canonical, count(*) AS row_count FROM tidy GROUP BY code, description, grade, t, d, g),
seen AS (SELECT d, string_agg(DISTINCT canonical, ', ' ORDER BY canonical) AS stocked, count(DISTINCT g) AS n FROM forms WHERE g IS NOT NULL GROUP BY d),
resolved AS (SELECT f.*, stocked,
  CASE t WHEN 0 THEN 'canonical_code' WHEN 1 THEN 'parsed_code' WHEN 2 THEN 'parsed_code+grade_column' WHEN 3 THEN 'parsed_code+grade_in_description' WHEN 4 THEN 'parsed_description'
    WHEN 5 THEN CASE WHEN n = 1 THEN 'grade_inferred_single_stocked_grade' WHEN n > 1 THEN 'grade_ambiguous' ELSE 'designation_without_grade' END WHEN 6 THEN 'non_section_passthrough' WHEN 7 THEN 'unparsed' ELSE 'source_conflict' END || CASE WHEN d = 2 AND t < 5 THEN '+not_in_catalogue' ELSE '' END AS method,
  CAST(CASE WHEN t < 5 THEN CASE WHEN d = 2 THEN 90 ELSE CASE t WHEN 0 THEN 100 ELSE 99 - t END END WHEN t = 5 THEN CASE WHEN n = 1 THEN 90 WHEN n > 1 THEN 85 ELSE 70 END WHEN t = 6 THEN 100 WHEN t = 7 THEN 0 ELSE 82 END AS DOUBLE) AS score FROM forms f LEFT JOIN seen USING (d)),
banded AS (SELECT *, CASE WHEN score >= 95 THEN 'auto' WHEN score >= 80 THEN 'review' ELSE 'unmatched' END AS status, CASE WHEN t = 5 THEN stocked WHEN t = 8 THEN canonical END AS candidates FROM resolved)
"""


def _forms(spark, sf):
    read(spark, sf, "part").createOrReplaceTempView("part")
    written = spark.sql(_WRITTEN).select(F.lit("part").alias("source_table"), "code", "description", "grade", F.lit(None).cast("string").alias("section_type"), "uom", "unit_weight")
    catalogue = spark.createDataFrame([("UB", "203X133X25", 25.1), ("UC", "152X152X37", 37.0)], "kind string, dims string, kg_per_m double")
    return materials.resolve(materials.forms([written]), catalogue), catalogue


@query("material_forms", _RESOLVED + "SELECT code, description, grade, row_count, method, score, status, CASE WHEN t = 6 THEN code WHEN status = 'auto' THEN canonical END AS canonical_code, candidates FROM banded")
def material_forms(spark, sf):
    return _forms(spark, sf)[0].select("code", "description", "grade", "row_count", "method", "score", "status", "canonical_code", "candidates")


@query("material_golden", _RESOLVED + f""", waiting AS (SELECT unnest(string_split(coalesce(candidates, canonical), ', ')) AS c, row_count FROM banded WHERE status = 'review'),
used AS (SELECT {_BASE} || '-' || g AS canonical, string_agg(DISTINCT uom, ', ' ORDER BY uom) AS observed_uoms, count(DISTINCT uom) > 1 AS uom_conflict FROM tidy WHERE t < 5 GROUP BY 1),
one AS (SELECT canonical, d, count(*) AS forms, sum(row_count) AS source_rows FROM banded WHERE status = 'auto' AND t < 5 GROUP BY canonical, d)
SELECT canonical AS canonical_code, CASE d WHEN 0 THEN 25.1 WHEN 1 THEN 157 ELSE 37 END::DOUBLE AS mass, CASE d WHEN 1 THEN 'plate: 7.85 kg/m2 per mm' ELSE 'section catalogue' END AS mass_source, d = 3 AS mass_deviation, CASE d WHEN 0 THEN 301.2 WHEN 3 THEN 444 END::DOUBLE AS kg_per_ea,
  observed_uoms, uom_conflict, forms, CAST(source_rows AS BIGINT) AS source_rows, CAST(coalesce((SELECT sum(row_count) FROM waiting WHERE c = canonical), 0) AS BIGINT) AS pending_review_rows FROM one JOIN used USING (canonical)""")
def material_golden(spark, sf):
    resolved, catalogue = _forms(spark, sf)
    return materials.golden(resolved, catalogue).select("canonical_code", "mass", "mass_source", "mass_deviation", "kg_per_ea", "observed_uoms", "uom_conflict", "forms", "source_rows", "pending_review_rows")


_PARTIES = """
WITH RECURSIVE r0 AS (SELECT p_name AS name, min(p_partkey) AS key, count(*) AS documents FROM part GROUP BY 1), rec AS (SELECT *, CASE WHEN key % 2 = 0 THEN 'mrp' ELSE 'finance' END AS system FROM r0),
pairs AS (SELECT x.key AS a, y.key AS b, CAST(100 - 5 * levenshtein(x.name, y.name) AS DOUBLE) AS score, x.system <> y.system AS cross_system, x.name AS na, y.name AS nb, x.system AS sa FROM rec x JOIN rec y ON split_part(x.name, ' ', 1) = split_part(y.name, ' ', 1) AND x.key < y.key),
held AS (SELECT DISTINCT l_orderkey, p_name AS name, system FROM lineitem JOIN part ON l_partkey = p_partkey JOIN rec ON rec.name = p_name),
inv AS (SELECT x.name AS code, y.name AS account, count(*) AS n FROM held x JOIN held y USING (l_orderkey) WHERE x.system = 'mrp' AND y.system = 'finance' GROUP BY 1, 2),
scored AS (SELECT a, b, score, CASE WHEN score >= 80 THEN 'auto' WHEN score >= 75 THEN 'review' ELSE 'unmatched' END AS status, cross_system, CAST(coalesce(CASE
  WHEN cross_system THEN (SELECT sum(n) FROM inv WHERE (code = na AND account = nb) OR (code = nb AND account = na))
  WHEN sa = 'mrp' THEN (SELECT sum(least(u.n, v.n)) FROM inv u JOIN inv v USING (account) WHERE u.code = na AND v.code = nb)
  ELSE (SELECT count(*) FROM inv u JOIN inv v USING (code) WHERE u.account = na AND v.account = nb) END, 0) AS BIGINT) AS support FROM pairs),
e AS (SELECT a, b FROM scored WHERE status = 'auto' UNION SELECT b, a FROM scored WHERE status = 'auto'),
reach AS (SELECT key AS node, key AS seen FROM rec UNION SELECT reach.node, e.b FROM reach JOIN e ON reach.seen = e.a), comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
"""


def _records(spark, sf):
    one = read(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("key"), F.count("*").alias("documents"))
    return one.select("key", F.when(F.col("key") % 2 == 0, "mrp").otherwise("finance").alias("system"), F.col("name").alias("code"), "name", "documents")


def _scored(spark, sf):
    records = _records(spark, sf)
    pairs = block_pairs(records, "key", "name").select("a", "b", (100 - 5 * F.levenshtein("name_a", "name_b")).cast("double").alias("score")).withColumn("status", band(F.col("score"), 80, 75))
    parts = read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("code"))
    held = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(parts, "l_partkey").select("l_orderkey", "code").distinct().join(records.select("code", "system"), "code")
    codes, accounts = held.filter("system = 'mrp'").select("l_orderkey", "code"), held.filter("system = 'finance'").select("l_orderkey", F.col("code").alias("account"))
    invoiced = codes.join(accounts, "l_orderkey").groupBy("code", "account").agg(F.count("*").alias("n"))
    return records, parties.evidence(pairs, records, invoiced)


def _entities(spark, sf):
    records, scored = _scored(spark, sf)
    return records, scored, connected_components(records.select(F.col("key").alias("node")), scored.filter("status = 'auto'"))


@query("pair_evidence", _PARTIES + "SELECT a, b, score, status, cross_system, support FROM scored")
def pair_evidence(spark, sf):
    return _scored(spark, sf)[1]


@query("likely_missed_pairs", _PARTIES + "SELECT a, b, score, support FROM scored WHERE status = 'unmatched' AND cross_system AND support > 0")
def likely_missed_pairs(spark, sf):
    return parties.likely_missed(_scored(spark, sf)[1]).select("a", "b", "score", "support")


@query("party_golden", _PARTIES + """
SELECT component AS entity_id, count(*) AS members, arg_min(name, (system <> 'finance', -documents, name)) AS name, arg_min(system, (system <> 'finance', -documents, name)) AS named_by, count(*) FILTER (WHERE system = 'finance') AS n_first, count(*) - 1 AS duplicates
FROM rec JOIN comp ON key = node GROUP BY component""")
def party_golden(spark, sf):
    records, _, components = _entities(spark, sf)
    return parties.golden_names(records, components, "finance")


@query("party_crosswalk", _PARTIES + """
, ends AS (SELECT a AS key, b AS other, score, status FROM scored WHERE cross_system UNION ALL SELECT b, a, score, status FROM scored WHERE cross_system),
best AS (SELECT key, arg_min(other, (-score, other)) AS other, max(score) AS score, arg_min(status, (-score, other)) AS status FROM ends GROUP BY key),
mixed AS (SELECT component, count(DISTINCT system) > 1 AS mixed FROM rec JOIN comp ON key = node GROUP BY component)
SELECT rec.key, component AS entity_id, other AS best_counterpart, score, CASE WHEN mixed THEN 'auto' WHEN status = 'review' THEN 'review' ELSE 'unmatched' END AS status FROM rec JOIN comp ON key = node JOIN mixed USING (component) LEFT JOIN best ON best.key = rec.key""")
def party_crosswalk(spark, sf):
    records, scored, components = _entities(spark, sf)
    return parties.crosswalk(records, components, scored)


@query("entity_review_queue", _PARTIES + """
SELECT least(x.component, y.component) AS left_entity, greatest(x.component, y.component) AS right_entity, count(*) AS n_pairs, max(score) AS score, max(support) AS support, CASE WHEN max(support) > 0 THEN 'approve merge: invoices corroborate' ELSE 'check VAT number, address and bank details' END AS action
FROM scored JOIN comp x ON a = x.node JOIN comp y ON b = y.node WHERE status = 'review' AND x.component <> y.component GROUP BY 1, 2""")
def entity_review_queue(spark, sf):
    _, scored, components = _entities(spark, sf)
    return parties.entity_queue(scored, components)


#: Customers as jobs, written in the shop's ways, and in finance's code. SQL that both engines read.
_JOB = "concat('J-', CAST(10 + FLOOR(c_custkey / 10000) AS INT), '-', lpad(CAST(c_custkey % 10000 AS {text}), 4, '0'))"
_REFERENCES = """
SELECT CASE c_custkey % 6 WHEN 0 THEN job WHEN 1 THEN concat('j', substr(job, 2)) WHEN 2 THEN concat('J', substr(job, 3)) WHEN 3 THEN substr(job, 3) WHEN 4 THEN concat('j-', substr(job, 3, 3), CAST(c_custkey % 1000 AS {text})) ELSE concat('job ', CAST(c_custkey AS {text})) END AS written,
CASE WHEN c_custkey % 5 = 0 OR c_custkey >= 1000 AND c_custkey % 6 = 4 THEN 'ZZ' ELSE c_mktsegment END AS customer, o_custkey, CAST(count(*) AS BIGINT) AS n_rows FROM (SELECT *, """ + _JOB + """ AS job FROM customer) c JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3"""
_CODES = "SELECT concat(CAST(10 + FLOOR(c_custkey / 10000) AS INT), CAST(c_custkey % 10000 AS {text})) AS code FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 10000 > 0"

_LINKS = f"""
refs AS (SELECT written, customer, n_rows, o_custkey % 6 AS form, o_custkey FROM ({_REFERENCES.format(text="VARCHAR")})),
meant AS (SELECT *, CASE WHEN form < 4 THEN o_custkey WHEN form = 4 THEN CAST(floor(o_custkey / 10000) AS BIGINT) * 10000 + o_custkey % 1000 END AS c, CASE form WHEN 0 THEN 'exact' WHEN 1 THEN 'case_normalised' WHEN 2 THEN 'missing_hyphen' WHEN 3 THEN 'missing_prefix' WHEN 4 THEN 'zero_padding_restored' ELSE 'unparsed' END AS m,
  CASE form WHEN 0 THEN 100.0 WHEN 1 THEN 99.0 WHEN 2 THEN 97.0 WHEN 3 THEN 96.0 WHEN 4 THEN 95.0 ELSE 0.0 END::DOUBLE AS s FROM refs),
likened AS (SELECT m.*, k.c_custkey IS NOT NULL AND k.c_custkey % 7 <> 0 AS found, CASE WHEN k.c_custkey IS NULL THEN NULL WHEN customer = k.c_mktsegment THEN 100.0 WHEN customer = 'ZZ' THEN 0.0 ELSE -1 END::DOUBLE AS liked, {_JOB.format(text="VARCHAR").replace("c_custkey", "m.c")} AS job FROM meant m LEFT JOIN customer k ON k.c_custkey = m.c),
linked AS (SELECT written, CASE WHEN form < 5 THEN job END AS job, any_value(m) AS m, any_value(s) AS s, bool_or(found) AS found, CAST(sum(n_rows) AS BIGINT) AS n_rows, round(sum(liked * n_rows) / sum(n_rows), 1) AS agreement FROM likened GROUP BY 1, 2),
links AS (SELECT written, n_rows, job, CASE WHEN job IS NULL THEN m WHEN NOT found THEN m || '_not_found' WHEN agreement < 80 THEN m || '+customer_disagrees' ELSE m END AS method, CASE WHEN NOT found THEN 0 WHEN agreement < 80 THEN least(s, 85) ELSE s END::DOUBLE AS score, CASE WHEN found THEN agreement END AS agreement FROM linked),
judged AS (SELECT *, CASE WHEN score >= 95 THEN 'auto' WHEN score >= 80 THEN 'review' ELSE 'unmatched' END AS status FROM links),
final AS (SELECT written, n_rows, CASE WHEN status <> 'unmatched' THEN job END AS job_no, method, score, agreement, status FROM judged),
known AS (SELECT {_JOB.format(text="VARCHAR")} AS job_no FROM customer WHERE c_custkey % 7 <> 0),
codes AS (SELECT DISTINCT code, 'J-' || substr(code, 1, 2) || '-' || lpad(substr(code, 3), 4, '0') AS job_no FROM ({_CODES.format(text="VARCHAR")}))"""


def _jobs(spark, sf):
    customer, orders = read(spark, sf, "customer"), read(spark, sf, "orders")
    bound = lambda sql: spark.sql(sql.format(text="STRING").replace("FROM customer", "FROM {customer}").replace("JOIN orders", "JOIN {orders}"), customer=customer, **({"orders": orders} if "JOIN orders" in sql else {}))
    jobs = bound(f"SELECT {_JOB} AS job_no FROM customer WHERE c_custkey % 7 <> 0")
    own = bound(f"SELECT {_JOB} AS job_no, c_mktsegment AS customer FROM customer")
    return jobs, bound(_CODES), parties.job_links(bound(_REFERENCES).drop("o_custkey"), jobs, own)


@query("job_reference_links", "WITH " + _LINKS.strip() + " SELECT * FROM final")
def job_reference_links(spark, sf):
    return _jobs(spark, sf)[2]


@query("job_crosswalk", "WITH " + _LINKS.strip() + """,
best AS (SELECT job_no, string_agg(written, ', ' ORDER BY written) AS forms, CAST(sum(n_rows) AS BIGINT) AS n, min(score) AS least, arg_min(method, (score, written)) AS weakest FROM final WHERE status = 'auto' GROUP BY 1)
SELECT k.job_no, c.code AS finance_job_code, c.code IS NOT NULL AS in_finance, coalesce(forms, '') AS ops_reference_forms, coalesce(n, 0) AS ops_rows, n IS NOT NULL AS in_ops, coalesce(least, 100.0::DOUBLE) AS confidence, coalesce(weakest, 'finance derived key') AS weakest_link FROM known k LEFT JOIN codes c USING (job_no) LEFT JOIN best b USING (job_no)
UNION ALL SELECT NULL, code, true, '', 0, false, 0.0::DOUBLE, 'no job' FROM codes WHERE job_no NOT IN (SELECT job_no FROM known)""")
def job_crosswalk(spark, sf):
    return parties.job_crosswalk(*_jobs(spark, sf))


@query("job_unlinked", "WITH " + _LINKS.strip() + """
SELECT 'jobs' AS side, job_no AS value, 'no finance job code' AS reason FROM known WHERE job_no NOT IN (SELECT job_no FROM codes)
UNION ALL SELECT 'jobs', job_no, 'no shop-floor delivery note' FROM known WHERE job_no NOT IN (SELECT job_no FROM final WHERE status = 'auto')
UNION ALL SELECT 'finance', code, 'derived_key_not_found' FROM codes WHERE job_no NOT IN (SELECT job_no FROM known)
UNION ALL SELECT 'shop_floor', written, CASE WHEN status = 'review' THEN 'held for review: ' ELSE '' END || method FROM final WHERE status <> 'auto'""")
def job_unlinked(spark, sf):
    return parties.unlinked(*_jobs(spark, sf))
