"""The relational vocabulary of the operators: joins, aggregates, windows and sets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import joins
from ..operators import provenance
from ..operators.provenance import number_tokens
from ..sources import publish
from .registry import query, read


@query("label_coverage", "SELECT d.doc_id, d.source, l.quality, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def label_coverage(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "source")
    return joins.matched(docs, read(spark, sf, "labels"), {"doc_id": "doc_id"}, "labelled", ["quality"])


@query("orders_without_lines", "SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def orders_without_lines(spark, sf):
    return read(spark, sf, "orders").join(read(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("customers_with_urgent_orders", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def customers_with_urgent_orders(spark, sf):
    urgent = read(spark, sf, "orders").filter(F.col("o_orderpriority").like("1%"))
    return read(spark, sf, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("nation_in_either", """
SELECT n_name, count(*) AS n_trades FROM (SELECT DISTINCT c.c_nationkey, s.s_nationkey, l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey) t
JOIN nation n ON n.n_nationkey IN (t.c_nationkey, t.s_nationkey) GROUP BY n_name""")
def nation_in_either(spark, sf):
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", "o_custkey").distinct()
    trades = lines.join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("c_nationkey", "s_nationkey", "l_suppkey", "o_custkey")
    return joins.key_in_either(trades, read(spark, sf, "nation"), ["c_nationkey", "s_nationkey"], "n_nationkey").groupBy("n_name").agg(F.count("*").alias("n_trades"))


_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query("nearest_prior_order", f"""
SELECT {_LINE}, o_orderkey AS prior_order FROM (
SELECT {_LINE}, p.o_orderkey, row_number() OVER (PARTITION BY {_LINE}, l_shipdate ORDER BY p.o_orderdate DESC NULLS LAST, p.o_orderkey NULLS LAST) AS n
FROM (SELECT l.*, o.o_custkey AS cust FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey) e
LEFT JOIN orders p ON p.o_custkey = e.cust AND e.l_shipdate BETWEEN p.o_orderdate AND p.o_orderdate + INTERVAL 60 DAY) WHERE n = 1""")
def nearest_prior_order(spark, sf):
    orders = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("cust"), "o_orderdate")
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    events = lines.join(orders.select(F.col("o_orderkey").alias("k"), "cust"), F.col("l_orderkey") == F.col("k")).drop("k")
    found = joins.nearest_prior(events, orders, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], "cust", "l_shipdate", "o_orderdate", 60, "o_orderkey")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("o_orderkey").alias("prior_order"))


@query("months_full_outer", """
WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS orders_n FROM orders GROUP BY 1), l AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS lines_n FROM lineitem GROUP BY 1), e AS (SELECT strftime(ts, '%Y-%m') AS month, count(*) AS events_n FROM events GROUP BY 1)
SELECT coalesce(o.month, l.month, e.month) AS month, coalesce(orders_n, 0) AS orders_n, coalesce(lines_n, 0) AS lines_n, coalesce(events_n, 0) AS events_n FROM o FULL JOIN l ON o.month = l.month FULL JOIN e ON coalesce(o.month, l.month) = e.month""")
def months_full_outer(spark, sf):
    by = lambda t, c, n: read(spark, sf, t).groupBy(F.date_format(c, "yyyy-MM").alias("month")).agg(F.count("*").alias(n))
    return joins.full_outer([by("orders", "o_orderdate", "orders_n"), by("lineitem", "l_shipdate", "lines_n"), by("events", "ts", "events_n")], "month").fillna(0)


@query("rollup_accuracy", """
SELECT CASE WHEN grouping(c_mktsegment) = 1 THEN 'All segments' ELSE c_mktsegment END AS segment, CASE WHEN grouping(n_name) = 1 THEN 'All nations' ELSE n_name END AS nation,
count(*) AS n_customers, count(*) FILTER (WHERE c_acctbal < 0) AS n_negative, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (c_mktsegment, n_name)""")
def rollup_accuracy(spark, sf):
    joined = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rolled = joined.rollup("c_mktsegment", "n_name").agg(F.grouping("c_mktsegment").alias("g1"), F.grouping("n_name").alias("g2"), F.count("*").alias("n_customers"), F.count_if(F.col("c_acctbal") < 0).alias("n_negative"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("balance"))
    return rolled.select(F.when(F.col("g1") == 1, "All segments").otherwise(F.col("c_mktsegment")).alias("segment"), F.when(F.col("g2") == 1, "All nations").otherwise(F.col("n_name")).alias("nation"), "n_customers", "n_negative", "balance")


@query("modal_type_per_brand", "SELECT p_brand, p_type AS modal_type, n AS n_parts, types FROM (SELECT p_brand, p_type, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS k FROM part GROUP BY 1, 2) JOIN (SELECT p_brand, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS types FROM part GROUP BY 1) USING (p_brand) WHERE k = 1")
def modal_type_per_brand(spark, sf):
    return read(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).groupBy("p_brand").agg(F.min(F.struct((-F.col("n")).alias("o"), "p_type"))["p_type"].alias("modal_type"), F.max("n").alias("n_parts"), F.array_join(F.array_sort(F.collect_set("p_type")), ", ").alias("types"))


@query("dedup_keep_first", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) > 1 AS is_repeat FROM lineitem")
def dedup_keep_first(spark, sf):
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return joins.repeats(lines, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query("top_orders_per_segment", "SELECT c_mktsegment, o_orderkey, place FROM (SELECT c_mktsegment, o_orderkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders JOIN customer ON o_custkey = c_custkey) WHERE place <= 4")
def top_orders_per_segment(spark, sf):


    joined = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    place = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    return joined.select("c_mktsegment", "o_orderkey", place.alias("place")).filter("place <= 4")


@query("null_safe_composite_join", """
WITH a AS (SELECT l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS flag, count(*) AS n FROM lineitem GROUP BY 1, 2), b AS (SELECT l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag END AS flag, count(*) AS m FROM lineitem GROUP BY 1, 2)
SELECT a.l_partkey, a.flag, n, m FROM a JOIN b ON a.l_partkey = b.l_partkey AND a.flag IS NOT DISTINCT FROM b.flag""")
def null_safe_composite_join(spark, sf):
    lines = read(spark, sf, "lineitem")
    side = lambda k, n: lines.groupBy("l_partkey", F.when(F.col("l_linenumber") % k == 0, F.col("l_returnflag")).alias("flag")).agg(F.count("*").alias(n))
    a, b = side(2, "n").alias("a"), side(3, "m").alias("b")
    return a.join(b, (F.col("a.l_partkey") == F.col("b.l_partkey")) & F.col("a.flag").eqNullSafe(F.col("b.flag"))).select("a.l_partkey", "a.flag", "n", "m")


@query("active_keys_union", "SELECT k, k IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS in_credit FROM (SELECT o_custkey AS k FROM orders UNION SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def active_keys_union(spark, sf):
    keys = read(spark, sf, "orders").select(F.col("o_custkey").alias("k")).union(read(spark, sf, "events").filter("user_id is not null").select("user_id")).distinct()
    return joins.matched(keys, read(spark, sf, "customer").filter("c_acctbal > 0"), {"k": "c_custkey"}, "in_credit")


@query("exact_duplicate_rows", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n > 1")
def exact_duplicate_rows(spark, sf):
    hashed = read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = hashed.groupBy("h").agg(F.min("doc_id").alias("first"))
    return hashed.join(first, "h").filter(F.col("doc_id") != F.col("first")).select("doc_id")


@query("conversation_turn_gaps", "SELECT conv_id, role, turn, turn - prev AS gap FROM (SELECT conv_id, role, turn, lag(turn) OVER (PARTITION BY conv_id, role ORDER BY turn) AS prev FROM (SELECT DISTINCT conv_id, role, turn FROM conversations)) WHERE turn - prev <> 1")
def conversation_turn_gaps(spark, sf):
    """Turns of a speaker that don't follow on the same speaker's last one."""
    turns = read(spark, sf, "conversations").select("conv_id", "role", "turn").distinct()
    gap = F.col("turn") - F.lag("turn").over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    return turns.select("conv_id", "role", "turn", gap.alias("gap")).filter("gap <> 1")


@query("number_tokens", "SELECT doc_id, tokens[i] AS token, i - 1 AS place FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[0-9]{1,3}(?:,[0-9]{3})+(?:\\.[0-9]+)?|[0-9]+(?:\\.[0-9]+)?') AS tokens FROM documents))")
def number_tokens_query(spark, sf):
    return number_tokens(read(spark, sf, "documents"), "doc_id", "text")


#: A sentence on each order, with identifiers among its figures. SQL that both engines read.
_SAID = """
SELECT o_orderkey, concat('On ', CAST(CAST(o_orderdate AS DATE) AS {text}), ' job J-24-', lpad(CAST(o_orderkey % 10000 AS {text}), 4, '0'), ' (DQ-0', CAST(o_orderkey % 9 AS {text}), CASE WHEN o_orderkey % 3 = 0 THEN ', EN 1090-2, clause 6.2.1' ELSE '' END,
') billed ', CAST(o_custkey AS {text}), ',250.75 for ', CAST(o_orderkey % 40 AS {text}), ' lines in phases 1, 2 and 3, ', CAST(o_orderkey % 7 AS {text}), ' of 12 late; Page ', CAST(o_orderkey % 5 AS {text}), ', M', CAST(o_orderkey % 12 AS {text}), ', 31/12/2024.') AS said FROM orders"""
_MASKED = "said"
for _, _pattern in provenance.MASKS:
    _MASKED = f"regexp_replace({_MASKED}, '{_pattern}', ' ', 'g')"


def _said(spark, sf):
    return spark.sql(_SAID.format(text="STRING").replace("FROM orders", "FROM {orders}"), orders=read(spark, sf, "orders"))


@query("figure_tokens", f"SELECT o_orderkey, tokens[i] AS token, i - 1 AS place FROM (SELECT o_orderkey, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM (SELECT o_orderkey, regexp_extract_all({_MASKED}, '[0-9]{{1,3}}(?:,[0-9]{{3}})+(?:\\.[0-9]+)?|[0-9]+(?:\\.[0-9]+)?') AS tokens FROM ({_SAID.format(text='VARCHAR')})))")
def figure_tokens(spark, sf):
    return provenance.figure_tokens(_said(spark, sf), "o_orderkey", "said")


@query("identifier_kinds", "SELECT * FROM (SELECT o_orderkey, unnest(['date', 'job', 'rule', 'standard', 'clause', 'page', 'month', 'phase']) AS kind, CAST(unnest([2, 1, 1, CAST(o_orderkey % 3 = 0 AS INT), CAST(o_orderkey % 3 = 0 AS INT), 1, 1, 1]) AS BIGINT) AS n FROM orders) WHERE n > 0")
def identifier_kinds(spark, sf):
    return provenance.structure(_said(spark, sf), "o_orderkey", "said")


@query("one_to_one_merge", "SELECT o_orderkey, o_custkey, n_lines, quantity FROM orders JOIN (SELECT l_orderkey, count(*) AS n_lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def one_to_one_merge(spark, sf):
    sums = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    return joins.one_to_one(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), sums, "o_orderkey")


_YEAR = "SELECT c_mktsegment, o_orderstatus, count(*) AS n_orders FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderdate > (SELECT max(o_orderdate) FROM {orders}) - INTERVAL 12 MONTH GROUP BY ALL ORDER BY ALL"


@query("orders_of_last_year", _YEAR.format(orders="orders", customer="customer"))
def orders_of_last_year(spark, sf):
    return spark.sql(_YEAR, orders=read(spark, sf, "orders"), customer=read(spark, sf, "customer"))


_LOOKUP = "SELECT s_suppkey, (SELECT max(n_name) FROM {nation} WHERE n_nationkey = s_nationkey AND n_regionkey < 3) AS nation, CAST(try_cast(s_acctbal AS DOUBLE) < 0 AS INT) AS in_debt FROM {supplier}"


@query("correlated_lookup", _LOOKUP.format(nation="nation", supplier="supplier"))
def correlated_lookup(spark, sf):
    return spark.sql(_LOOKUP, nation=read(spark, sf, "nation"), supplier=read(spark, sf, "supplier"))


@query("updated_in_place", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus ELSE o_orderpriority END AS o_orderpriority FROM orders")
def updated_in_place(spark, sf):
    return publish.updated(read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderkey % 5 = 0", {"o_orderstatus": "'X'", "o_orderpriority": "o_orderstatus"})
