"""The corpus operators over their whole tables, and the SQL of their results where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, conversation_sql, conversation_trie, decontaminate, exact_dedup, license_scan, line_dedup, mixture, quality_classifier, secret_scan, simhash_dedup, substring_dedup, url_filter, warc
from .common import cut, remove, shared_folder, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_dedup(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shard")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.kept_texts(table(spark, sf_dir, "documents"), with_text=False)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations")
    found = conversation_repair.repair_digests(conversation_repair.damage(convs))
    every = convs.select(F.col("conv_id").cast("long").alias("every_id")).distinct()
    nothing = {c: F.coalesce(c, F.lit(0)) for c in (*conversation_repair.COUNTS, "cost")} | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))}
    return every.join(found, F.col("every_id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("every_id", "conv_id").withColumns(nothing)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(table(spark, sf_dir, "pages"), folder)
    read = cut(warc.read_warc(spark, folder).drop("url"))
    remove(spark, folder)
    return read


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = conversation_trie.turn_arrays(table(spark, sf_dir, "conversations"))
    return conversation_trie.prefix_trie(conversation_trie.grafted(arrays))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_license_scan, op3_decontaminate, op4_quality_classifier, op5_simhash_dedup, op6_url_filter, op7_exact_dedup, op8_mixture, op9_secret_scan, op10_line_dedup, op11_conversation_repair, op12_warc, op13_conversation_trie)}

_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TEMPLATES = ", ".join(f"({k}, '{label}', {k <= len(license_scan.PHRASES)}, string_split('{text}', ' '))" for k, (text, label) in enumerate([*license_scan.PHRASES, *license_scan.NOTICES], 1))

ORACLES = {
    "op2_license_scan": f"""
WITH tokens AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '{license_scan.WORDS}') AS w FROM documents),
templates AS (SELECT * FROM (VALUES {_TEMPLATES}) AS t(template, label, phrase, w)),
wanted AS (SELECT template, pos AS tpos, w[pos + 1] AS a, w[pos + 2] AS b FROM (SELECT template, w, unnest(range(len(w) - 1)) AS pos FROM templates)),
grams AS (SELECT doc_id, pos, w[pos + 1] AS a, w[pos + 2] AS b FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 1, 0))) AS pos FROM tokens)),
votes AS (SELECT doc_id, template, pos - tpos AS diagonal, bit_or(CAST(1 AS BIGINT) << tpos) AS mask, min(pos) AS low, max(pos) AS high FROM grams JOIN wanted USING (a, b) GROUP BY ALL),
marked AS (SELECT v.*, label, phrase, len(w) - 1 AS n, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > CASE WHEN phrase THEN 0 ELSE {license_scan.BAND} END, false) AS apart FROM votes v JOIN templates USING (template)),
numbered AS (SELECT *, sum(apart::INT) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM marked),
spans AS (SELECT doc_id, label, phrase, n, bit_count(bit_or(mask))::DOUBLE / n AS share, min(low) AS low, max(high) AS high FROM numbered GROUP BY doc_id, template, label, phrase, n, span),
judged AS (SELECT *, phrase AND share = 1 AS base, NOT phrase AND share >= {license_scan.COVERAGE} AND high - low + 1 <= ceil(n * {license_scan.STRETCH}::DOUBLE) AS notice FROM spans),
found AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(low) FILTER (WHERE base) AS first_word, max(low) FILTER (WHERE base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base OR notice) AS labels, max(share) FILTER (WHERE base OR notice) AS score FROM judged GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM tokens t LEFT JOIN found USING (doc_id)
""",
    "op6_url_filter": f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
whole AS (SELECT page_id, regexp_extract(rest, '^[^?#]*') AS u FROM cut),
parts AS (SELECT page_id, {_ASCII_LOWER.format("regexp_extract(u, '^[^/]*')")} AS host, substr(u, length(regexp_extract(u, '^[^/]*')) + 1) AS path FROM whole),
rules AS (SELECT * FROM (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')) AS r(rule, rule_host, rule_path, verdict)),
globs AS (SELECT * FROM (VALUES (1, '*/login*'), (2, '*/signup*'), (3, '*/cart/*'), (4, '*.ads.*'), (5, '*.jpg'), (6, '*.png'), (7, '*.zip')) AS g(place, pattern)),
found AS (SELECT page_id, host, path,
  (SELECT arg_max(rule, length(rule)) FROM rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS rule,
  (SELECT arg_max(verdict, length(rule)) FROM rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS rule_verdict,
  (SELECT arg_min(g.pattern, place) FROM globs g WHERE ('.' || host || path) LIKE replace(g.pattern, '*', '%')) AS pattern FROM parts)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN rule IS NULL THEN pattern END AS pattern FROM found
""",
    "op7_exact_dedup": """
WITH texts AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
ranked AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM texts)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM ranked
""",
    "op8_mixture": f"""
WITH RECURSIVE sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, CAST('0x' || substr(md5('mix:' || doc_id), 1, 15) AS BIGINT) AS hash FROM documents),
shape AS (SELECT greatest(0, CAST(ceil(log2(count(*) / {mixture.BLOCK_DOCS}.0)) AS INT)) AS bits, greatest(4, CAST(ceil(log2(count(*) / {mixture.SHARD_DOCS}.0)) AS INT)) AS levels FROM sized),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2.0::DOUBLE AS full_size FROM sources),
levels AS (SELECT *, row_number() OVER w AS place, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(full_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM weighed WINDOW w AS (ORDER BY full_size / weight, rank)),
chosen AS (SELECT arg_min(level, place) AS level FROM levels WHERE level * weight <= full_size),
aimed AS (SELECT source, rank, source_size, CAST(least(full_size, coalesce(c.level * weight, full_size)) AS DOUBLE) AS target FROM levels CROSS JOIN chosen c),
passed AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS passes FROM aimed),
blocked AS (SELECT d.*, rank, source_size, target, passes, CAST(floor(target) AS BIGINT) - passes * source_size AS rest, hash >> (60 - bits) AS block FROM sized d JOIN passed a ON d.source IS NOT DISTINCT FROM a.source CROSS JOIN shape),
blocks AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY block) - 1 AS ordinal, coalesce(sum(words) OVER (PARTITION BY rank ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, count(*) OVER (PARTITION BY rank) AS n_blocks FROM (SELECT rank, block, any_value(source_size) AS source_size, any_value(rest) AS rest, sum(size) AS words FROM blocked GROUP BY 1, 2)),
root AS (SELECT list(n_blocks ORDER BY rank) AS quotas FROM (SELECT DISTINCT rank, n_blocks FROM blocks)),
tree AS (
  SELECT 0 AS depth, 0::BIGINT AS node, quotas, []::BIGINT[] AS dealt, CAST(list_sum(quotas) AS BIGINT) AS n, CAST(list_sum(quotas) // 2 AS BIGINT) AS d FROM root
  UNION ALL
  SELECT CASE WHEN done THEN depth + 1 ELSE depth END, CASE WHEN done THEN 2 * node + side ELSE node END, own, CASE WHEN done THEN []::BIGINT[] ELSE list_append(dealt, x) END,
    CASE WHEN done THEN CAST(list_sum(own) AS BIGINT) ELSE n - k END, CASE WHEN done THEN CAST(list_sum(own) // 2 AS BIGINT) ELSE d - x END FROM (
    SELECT *, CASE WHEN NOT done THEN quotas WHEN side = 0 THEN dealt ELSE list_transform(range(1, len(quotas) + 1), lambda i: quotas[i] - dealt[i]) END AS own,
      CASE WHEN NOT done THEN coalesce(list_filter(range(lo, hi + 1), lambda y: list_sum(list_transform(range(lo, y + 1), lambda z: exp(lgamma(k + 1) - lgamma(z + 1) - lgamma(k - z + 1) + lgamma(n - k + 1) - lgamma(d - z + 1) - lgamma(n - k - d + z + 1) - lgamma(n + 1) + lgamma(d + 1) + lgamma(n - d + 1)))) >= u)[1], hi) END AS x FROM (
      SELECT *, greatest(0, d - (n - k)) AS lo, least(d, k) AS hi, unnest(CASE WHEN done THEN [0, 1] ELSE [0] END) AS side FROM (
        SELECT t.*, len(dealt) = len(quotas) AS done, coalesce(quotas[len(dealt) + 1], 0) AS k, (CAST('0x' || substr(md5(concat_ws(':', 'mix', depth, node, len(dealt))), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM tree t CROSS JOIN shape WHERE depth < levels) AS a) AS b) AS c),
leaves AS (SELECT node, unnest(range(1, len(quotas) + 1)) AS rank, unnest(quotas) AS q FROM tree CROSS JOIN shape WHERE depth = levels AND len(dealt) = 0),
ends AS (SELECT node, rank, sum(q) OVER (PARTITION BY rank ORDER BY node) AS upto FROM leaves),
stretched AS (SELECT b.rank, b.block, before, words, source_size, rest, CAST(count(e.node) AS INT) AS shard FROM blocks b LEFT JOIN ends e ON e.rank = b.rank AND e.upto <= ordinal GROUP BY ALL),
shared AS (SELECT *, min(before) OVER w AS since, max(before + words) OVER w AS until FROM stretched WINDOW w AS (PARTITION BY rank, shard)),
parts AS (SELECT rank, block, shard, before - since AS ahead, CASE WHEN source_size > 0 THEN CAST(rest AS HUGEINT) * until // source_size - CAST(rest AS HUGEINT) * since // source_size ELSE 0 END AS part FROM shared),
ordered AS (SELECT b.*, shard, part - ahead - coalesce(sum(size) OVER (PARTITION BY b.rank, b.block ORDER BY hash, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM blocked b JOIN parts p ON p.rank = b.rank AND p.block = b.block)
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(0, least(size, room)) AS BIGINT) AS taken, shard FROM ordered
""",
    "op10_line_dedup": f"""
WITH lines AS (SELECT doc_id, pos, parts[pos] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
keyed AS (SELECT *, {_ASCII_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
common AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, pos, line, keeper IS NOT NULL AND doc_id <> keeper AS lost FROM keyed LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(lost::INT) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256 FROM marked GROUP BY doc_id
""",
    "op11_conversation_repair": conversation_sql.REPAIR,
    "op12_warc": conversation_sql.WARC,
    "op13_conversation_trie": conversation_sql.TRIE,
}
