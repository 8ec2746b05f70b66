"""Entity matching over parts, suppliers and order numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalise_name
from ..operators import matching
from ..operators.components import connected_components
from .registry import query, read

SUFFIXES, ABBREVIATIONS = ["LTD", "LIMITED", "PLC", "CO", "COMPANY", "LLP", "UK"], {"NTH": "NORTHERN", "SECT": "SECTIONS", "SVCS": "SERVICES"}

_PAIRS = "WITH f AS (SELECT p_name AS n, min(p_partkey) AS k FROM part GROUP BY 1), pairs AS (SELECT x.k AS a, y.k AS b, x.n AS name_a, y.n AS name_b FROM f x JOIN f y ON split_part(x.n, ' ', 1) = split_part(y.n, ' ', 1) AND x.k < y.k)"


@query("name_pairs_levenshtein", _PAIRS + " SELECT a, b, CAST(levenshtein(name_a, name_b) AS INT) AS distance FROM pairs")
def name_pairs_levenshtein(spark, sf):
    return matching.block_pairs(read(spark, sf, "part"), "p_partkey", "p_name").select("a", "b", F.levenshtein("name_a", "name_b").alias("distance"))


def _lcs(a: str, b: str) -> str:
    """The longest common subsequence of two texts, as a row of the usual table for each character of the second."""
    codes = lambda x: f"list_transform(range(1, length({x}) + 1), lambda i: unicode(substr({x}, i, 1)))"
    row = f"list_transform(range(1, length({a}) + 1), lambda j: greatest(row[j], coalesce(list_max(list_transform(list_filter(range(1, j + 1), lambda i: unicode(substr({a}, i, 1)) = c[1]), lambda i: coalesce(row[i - 1], 0) + 1)), 0)))"
    return f"list_reduce([list_transform(range(length({a})), lambda i: 0)] || list_transform({codes(b)}, lambda x: [x]), lambda row, c: {row})[-1]"


_SCORED = _PAIRS + f""", alike AS (SELECT *, array_to_string(list_sort(string_split(name_a, ' ')), ' ') AS sa, array_to_string(list_sort(string_split(name_b, ' ')), ' ') AS sb, replace(name_a, ' ', '') AS ca, replace(name_b, ' ', '') AS cb FROM pairs),
scored AS (SELECT a, b, name_a, name_b, round(greatest(200.0::DOUBLE * {_lcs("sa", "sb")} / (length(sa) + length(sb)), 200.0::DOUBLE * {_lcs("ca", "cb")} / (length(ca) + length(cb))), 1) AS score FROM alike)"""
_BANDS = "CASE WHEN score >= 90 THEN 'auto' WHEN score >= 70 THEN 'review' ELSE 'unmatched' END"


@query("name_pairs_indel", f"{_SCORED} SELECT *, {_BANDS} AS status FROM scored")
def name_pairs_indel(spark, sf):
    return matching.score_pairs(matching.block_pairs(read(spark, sf, "part"), "p_partkey", "p_name"), 90, 70)


@query("name_pairs_similar", f"{_SCORED} SELECT * FROM scored WHERE score >= 70")
def name_pairs_similar(spark, sf):
    return matching.similar_pairs(read(spark, sf, "part"), "p_partkey", "p_name", 70)


@query("match_review_queue", f"{_SCORED} SELECT *, 'review' AS status, CAST(row_number() OVER (ORDER BY score DESC, a, b) AS INT) AS place FROM scored WHERE score >= 70 AND score < 90")
def match_review_queue(spark, sf):
    return matching.review_queue(name_pairs_similar(spark, sf).withColumn("status", matching.band(F.col("score"), 90, 70)), ["a", "b"])


@query("name_components", _PAIRS.replace("WITH f", "WITH RECURSIVE f") + """
, e AS (SELECT a, b FROM pairs WHERE levenshtein(name_a, name_b) <= 8 UNION SELECT b, a FROM pairs WHERE levenshtein(name_a, name_b) <= 8),
r AS (SELECT k AS node, k AS seen FROM f UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a) SELECT node, min(seen) AS component FROM r GROUP BY node""")
def name_components(spark, sf):
    nodes = read(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("node")).select("node")
    return connected_components(nodes, name_pairs_levenshtein(spark, sf).filter("distance <= 8"))


@query("golden_parts", _PAIRS.replace("WITH f", "WITH RECURSIVE f") + """
, e AS (SELECT a, b FROM pairs WHERE levenshtein(name_a, name_b) <= 8 UNION SELECT b, a FROM pairs WHERE levenshtein(name_a, name_b) <= 8),
r AS (SELECT k AS node, k AS seen FROM f UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a), c AS (SELECT node, min(seen) AS component FROM r GROUP BY node),
t AS (SELECT component, p_name, count(*) AS w FROM part JOIN f ON p_name = n JOIN c ON k = node GROUP BY 1, 2)
SELECT component AS entity_id, count(*) AS members, arg_min(p_name, (-w, p_name)) AS golden_name, CAST(sum(w) AS BIGINT) AS total_weight FROM t GROUP BY 1""")
def golden_parts(spark, sf):
    records = read(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"), F.count("*").alias("w"))
    return matching.golden(records, "k", "p_name", "w", name_pairs_levenshtein(spark, sf).filter("distance <= 8"))


@query("normalised_names", """
SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN bare || ' AND' WHEN 1 THEN 'NORTHERN ' || bare || ' SERVICES' ELSE bare END AS normalised FROM (SELECT s_suppkey, trim(regexp_replace(upper(s_name), '[^A-Z0-9]+', ' ', 'g')) AS bare FROM supplier)""")
def normalised_names(spark, sf):
    form = F.when(F.col("s_suppkey") % 3 == 0, F.concat("s_name", F.lit(" & Co. Ltd"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("Nth "), "s_name", F.lit(" Svcs"))).otherwise(F.concat(F.lower("s_name"), F.lit(" limited")))
    formed = read(spark, sf, "supplier").select("s_suppkey", form.alias("form"))
    return formed.select("s_suppkey", normalise_name(F.col("form"), SUFFIXES, ABBREVIATIONS).alias("normalised"))


@query("transposition_candidates", """
WITH known AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey % 7 = 0), wrong AS (SELECT o_orderkey AS w, CAST(o_orderkey AS VARCHAR) AS t, count(*) AS n_rows FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1),
swaps AS (SELECT w, n_rows, CAST(substr(t, 1, i - 1) || substr(t, i + 1, 1) || substr(t, i, 1) || substr(t, i + 2) AS BIGINT) AS c FROM (SELECT w, t, n_rows, unnest(range(1, length(t))) AS i FROM wrong))
SELECT DISTINCT w AS wrong, c AS candidate, n_rows, 85 AS score FROM swaps JOIN known ON c = k WHERE c <> w""")
def transposition_candidates(spark, sf):
    orders = read(spark, sf, "orders").select("o_orderkey")
    return matching.transposition_queue(orders.filter("o_orderkey % 7 <> 0"), orders.filter("o_orderkey % 7 = 0"), "o_orderkey", "o_orderkey")


@query("crosswalk_bands", "SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN 100 - o_orderkey % 30 ELSE 0 END AS confidence, CASE WHEN c_custkey IS NULL THEN 'unmatched' WHEN o_orderkey % 30 <= 5 THEN 'auto' WHEN o_orderkey % 30 <= 20 THEN 'review' ELSE 'unmatched' END AS status FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def crosswalk_bands(spark, sf):
    forms = read(spark, sf, "orders").select("o_orderkey", "o_custkey", (100 - F.col("o_orderkey") % 30).alias("score"))
    return matching.crosswalk(forms, read(spark, sf, "customer").filter("c_acctbal > 0"), "o_custkey", "c_custkey", "score").select("o_orderkey", "confidence", "status")


@query("match_quality", "SELECT count(*) AS forms, count(*) FILTER (WHERE k <= 5) AS auto, count(*) FILTER (WHERE k > 5 AND k <= 20) AS review, count(*) FILTER (WHERE k > 20) AS unmatched, CAST(count(*) FILTER (WHERE k <= 5) AS DOUBLE) / count(*) AS auto_share, CAST(sum(n) FILTER (WHERE k <= 5) AS DOUBLE) / sum(n) AS auto_row_share, count(*) FILTER (WHERE k > 5 AND k <= 20) * 4.0::DOUBLE AS review_minutes FROM (SELECT l_partkey, l_partkey % 30 AS k, count(*) AS n FROM lineitem GROUP BY 1)")
def match_quality(spark, sf):
    forms = read(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n_rows")).withColumn("status", matching.band(100 - F.col("l_partkey") % 30))
    return matching.quality(forms, 4.0)


#: Bookings of every seventh order's neighbours under two spellings, and the orders that are known. SQL that both engines read.
_BOOKED = """
SELECT 'bookings' AS source, CAST(o_orderkey AS {text}) AS written, o_orderkey AS number, o_orderstatus AS site, CAST(o_orderdate AS DATE) AS day, 1 AS n FROM orders WHERE o_orderkey % 7 <> 0
UNION ALL SELECT 'travel', 'WO ' || CAST(o_orderkey AS {text}), o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END, CAST(o_orderdate AS DATE), 2 FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 2 = 0"""


def _transpositions(spark, sf):
    booked = spark.sql(_BOOKED.format(text="STRING").replace("FROM orders", "FROM {orders}"), orders=read(spark, sf, "orders"))
    unknown = booked.groupBy("source", "written", "number").agg(F.collect_set("site").alias("sites"), F.min("day").alias("first_date"), F.max("day").alias("last_date"), F.sum("n").alias("n_rows"))
    day = F.col("o_orderdate").cast("date")
    known = read(spark, sf, "orders").filter("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("number"), F.col("o_custkey").alias("job"), F.col("o_orderstatus").alias("site"), day.alias("start"), F.date_add(day, 400).alias("finish"))
    return matching.transposition_evidence(unknown, known)


_EVIDENCE = f"""
WITH booked AS ({_BOOKED.format(text='VARCHAR')}), t AS (SELECT source, written, number AS w, CAST(number AS VARCHAR) AS t, list(DISTINCT site) FILTER (WHERE site IS NOT NULL) AS sites, min(day) AS first_date, max(day) AS last_date, sum(n) AS n FROM booked GROUP BY 1, 2, 3),
swaps AS (SELECT DISTINCT source, written, w, sites, first_date, last_date, n, CAST(substr(t, 1, i - 1) || substr(t, i + 1, 1) || substr(t, i, 1) || substr(t, i + 2) AS BIGINT) AS c FROM (SELECT *, unnest(range(1, length(t))) AS i FROM t)),
met AS (SELECT s.*, o_custkey AS job, CASE WHEN sites IS NOT NULL THEN list_contains(sites, o_orderstatus) END AS same, first_date >= CAST(o_orderdate AS DATE) - 30 AND last_date <= CAST(o_orderdate AS DATE) + 430 AS inside FROM swaps s JOIN orders ON c = o_orderkey AND o_orderkey % 7 = 0 WHERE c <> w),
items AS (SELECT w AS wrong, c AS candidate, string_agg(DISTINCT written, ', ' ORDER BY written) AS written_as, string_agg(DISTINCT source, ', ' ORDER BY source) AS sources, min(job) AS job, CAST(sum(n) AS BIGINT) AS n_rows, bool_or(same) AS site_matches, bool_or(inside) AS dates_in_window FROM met GROUP BY 1, 2)
"""


@query("transposition_evidence", _EVIDENCE + f"SELECT *, {matching.SWAPPED} AS score, CASE WHEN site_matches AND dates_in_window THEN '{matching.LIKELY}' ELSE '{matching.WEAK}' END AS suggested_action FROM items")
def transposition_evidence(spark, sf):
    return _transpositions(spark, sf)


@query("combined_review_queue", _EVIDENCE.replace("WITH booked", _PAIRS + ", booked") + f"""
SELECT 'supplier' AS domain, a || '-' || b AS item_id, name_a AS source_value, name_b AS proposed_match, 100.0::DOUBLE - levenshtein(name_a, name_b) AS score, 'name' AS method, 'compare the names' AS suggested_action, 6.0::DOUBLE AS est_minutes FROM pairs WHERE levenshtein(name_a, name_b) BETWEEN 5 AND 8
UNION ALL SELECT 'works_order', wrong || '-' || candidate, written_as, CAST(candidate AS VARCHAR), {matching.SWAPPED}, 'adjacent_digit_transposition', CASE WHEN site_matches AND dates_in_window THEN '{matching.LIKELY}' ELSE '{matching.WEAK}' END, 5.0 FROM items
UNION ALL SELECT 'job', CAST(o_orderkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), 100 - o_orderkey % 30, 'crosswalk', 'confirm the job', 3.0 FROM orders JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 WHERE o_orderkey % 30 BETWEEN 6 AND 20""")
def combined_review_queue(spark, sf):
    names = matching.block_pairs(read(spark, sf, "part"), "p_partkey", "p_name").withColumn("distance", F.levenshtein("name_a", "name_b")).filter("distance BETWEEN 5 AND 8")
    named = lambda method, action: (F.lit(method).alias("method"), F.lit(action).alias("suggested_action"))
    suppliers = names.select(F.concat_ws("-", "a", "b").alias("item_id"), F.col("name_a").alias("source_value"), F.col("name_b").alias("proposed_match"), (100 - F.col("distance")).alias("score"), *named("name", "compare the names"))
    swaps = _transpositions(spark, sf)
    orders = swaps.select(F.concat_ws("-", "wrong", "candidate").alias("item_id"), F.col("written_as").alias("source_value"), F.col("candidate").alias("proposed_match"), "score", F.lit("adjacent_digit_transposition").alias("method"), "suggested_action")
    forms = read(spark, sf, "orders").select("o_orderkey", "o_custkey", (100 - F.col("o_orderkey") % 30).alias("score"))
    walked = matching.crosswalk(forms, read(spark, sf, "customer").filter("c_acctbal > 0"), "o_custkey", "c_custkey", "score").filter("status = 'review'")
    jobs = walked.select(F.col("o_orderkey").alias("item_id"), F.col("o_orderkey").alias("source_value"), F.col("o_custkey").alias("proposed_match"), F.col("confidence").alias("score"), *named("crosswalk", "confirm the job"))
    return matching.combined_queue({"supplier": suppliers, "works_order": orders, "job": jobs}, {"supplier": 6, "works_order": 5, "job": 3})
