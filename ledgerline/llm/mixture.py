"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions alone.

Documents are put in a random order by a hash and cut into blocks, ranges of that hash; so a source's blocks are permuted. Its
blocks are the quotas of the tree's root: each node deals half of its blocks to its left child, a multivariate hypergeometric
draw made source by source by inverting the distribution function, until the leaves hold the exact quotas of the output
shards. Each shard takes its quota as a stretch of the source's permuted blocks, disjoint from the others', and draws its part
of the source's target from it: whole passes over the stretch, and a partial pass from its beginning, which ends within a
document so that the shards' words sum to the target. A shard orders what it has drawn by a hash. Running sums are made over
blocks of a source and over documents of a block, so no task holds a source. What comes back is the same in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, "mix"
#: Documents for each block and shard, and the most of both: beyond, blocks and shards grow and nothing is left out.
BLOCK_DOCS, MAX_BLOCKS, SHARD_DOCS, MAX_SHARDS = 64, 1 << 16, 1 << 16, 1 << 12
HASH_BITS = 60
SIZE = r"[^\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series from n + 8 on."""

    def series(y):
        return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)

    return _let(n.cast("double"), lambda x: series(x + 8) - F.log((x + 1) * (x + 2) * (x + 3) * (x + 4)) - F.log((x + 5) * (x + 6) * (x + 7)))


def hypergeometric(u: Column, population: Column, marked: Column, draws: Column) -> Column:
    """How many of ``draws`` from ``population`` are ``marked``, for a uniform u: the distribution function inverted.

    The walk covers twelve standard deviations on either side of the mean, beyond which less than 1e-30 lies.
    """

    def inside(x):
        lo, hi, n, k, d = x["lo"], x["hi"], x["n"], x["k"], x["d"]
        start = F.exp(
            _log_factorial(k) - _log_factorial(lo) - _log_factorial(k - lo) + _log_factorial(n - k) - _log_factorial(d - lo) - _log_factorial(n - k - d + lo)
            - _log_factorial(n) + _log_factorial(d) + _log_factorial(n - d)
        )
        zero = F.struct(start.alias("p"), F.lit(0.0).alias("sum"), hi.alias("at"), F.lit(False).alias("done"))

        def walk(s, y):
            total = s["sum"] + s["p"]
            here = ~s["done"] & (total >= x["u"])
            up = s["p"] * (k - y).cast("double") * (d - y).cast("double") / ((y + 1).cast("double") * F.greatest(n - k - d + y + 1, F.lit(1)).cast("double"))
            return F.struct(up.alias("p"), total.alias("sum"), F.when(here, y).otherwise(s["at"]).alias("at"), (s["done"] | here).alias("done"))

        return F.aggregate(F.sequence(lo, hi), zero, walk, lambda s: s["at"])

    def bounds(x):
        n, k, d = x["n"].cast("double"), x["k"].cast("double"), x["d"].cast("double")
        mean = d * k / F.greatest(n, F.lit(1.0))
        reach = 12 + 12 * F.sqrt(mean * F.greatest(1 - k / F.greatest(n, F.lit(1.0)), F.lit(0.0)))
        lo = F.greatest(F.lit(0).cast("long"), x["d"] - (x["n"] - x["k"]), F.floor(mean - reach).cast("long"))
        hi = F.least(x["d"], x["k"], F.ceil(mean + reach).cast("long"))
        return F.struct(x["u"].alias("u"), x["n"].alias("n"), x["k"].alias("k"), x["d"].alias("d"), lo.alias("lo"), hi.alias("hi"))

    given = F.struct(u.alias("u"), population.cast("long").alias("n"), marked.cast("long").alias("k"), draws.cast("long").alias("d"))
    return _let(_let(given, bounds), inside)


def _left(node: Column, quotas: Column, depth: Column) -> Column:
    """The left child's quotas: half of the node's blocks, dealt source by source."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda s, q: s + q)
    zero = F.struct(total.alias("n"), F.floor(total / 2).cast("long").alias("d"), F.array().cast("array<bigint>").alias("out"))

    def deal(s, q):
        named = F.concat_ws(":", F.lit(SEED), depth.cast("string"), node.cast("string"), F.size(s["out"]).cast("string"))
        u = (F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
        return _let(hypergeometric(u, s["n"], q, s["d"]), lambda x: F.struct((s["n"] - q).alias("n"), (s["d"] - x).alias("d"), F.concat(s["out"], F.array(x)).alias("out")))

    return F.aggregate(quotas, zero, deal, lambda s: s["out"])


def shard_quotas(root: DataFrame, shards: int) -> DataFrame:
    """(node, quotas) for each of ``shards`` leaves, a power of two, from one row with the sources' blocks as ``quotas``."""
    tree, depth = root.select(F.lit(0).cast("long").alias("node"), F.lit(0).alias("depth"), "quotas"), 0
    left, right = _left(F.col("node"), F.col("quotas"), F.col("depth")), F.zip_with("quotas", "left", lambda q, x: q - x)
    child = lambda k, quotas: F.struct((2 * F.col("node") + k).alias("node"), (F.col("depth") + 1).alias("depth"), quotas.alias("quotas"))
    children = F.inline(F.array(child(0, F.col("left")), child(1, right)))
    while 1 << depth < shards:
        tree, depth = tree.select("node", "depth", "quotas", left.alias("left")).select(children), depth + 1
    return tree


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, rank and target, from (source, source_size): water poured by weight up to ``cap`` times each size."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", weight)
    full = F.col("source_size") * F.lit(float(cap))
    order = Window.orderBy(full / F.col("weight"), "rank")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levels = ranked.select("source", "source_size", "rank", "weight", full.alias("full"), level.alias("level"), F.row_number().over(order).alias("place"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("full"), F.struct("place", "level"))
    chosen = levels.withColumn("chosen", F.min(fits).over(every)["level"])
    return chosen.select("source", "source_size", "rank", F.coalesce(F.least("full", F.col("chosen") * F.col("weight")), "full").alias("target"))


def _power(n: float, most: int) -> int:
    out = 0
    while 1 << out < min(n, most):
        out += 1
    return out


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _leaves(placed: DataFrame, shards: int) -> DataFrame:
    """node, rank and end: how many of a source's blocks the shards up to this one take, in order."""
    counts = placed.groupBy("rank").agg(F.max("n_blocks").alias("q"))
    root = counts.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "q"))), lambda x: x["q"]).alias("quotas"))
    dealt = shard_quotas(root, shards).select("node", F.posexplode("quotas").alias("place", "q"))
    return dealt.select("node", (F.col("place") + 1).alias("rank"), F.sum("q").over(Window.partitionBy("place").orderBy("node")).alias("end"))


def mix_plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, shards: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, h (a hash of the text), source, size, source_size, target, shard, taken and draws (shard, pass, words, place).

    Size is the number of runs without ASCII white space; null and empty texts have 0 and are never drawn. Sources are
    ranked by code point, null last, and weigh ``weights`` in turn; together they get ``share`` of all sizes, none more
    than ``cap`` times its own, the excess reshared by weight. A draw takes a whole document, or its first words where the
    partial pass of its shard ends; taken is the sum of the draws. No document is taken more than ceil(target / source_size)
    times its size. Repeated rows are rows of their own; an empty table gives an empty result; other columns are ignored.
    A node of the tree carries a number for each source, so sources may be thousands, not millions.
    """
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, HASH_BITS // 4), 16, 10).cast("long")
    slim = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("h"), F.col("source").cast("string").alias("source"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SIZE)).cast("long").alias("size"), hashed.alias("hash")))
    n = slim.count()
    bits = _power(n / BLOCK_DOCS, MAX_BLOCKS)
    shards = shards or 1 << max(4, _power(n / SHARD_DOCS, MAX_SHARDS))
    blocked = slim.withColumn("block", F.shiftright("hash", HASH_BITS - bits))
    blocks = blocked.groupBy("source", "block").agg(F.sum("size").alias("words"))
    sources = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    run = Window.partitionBy("source").orderBy("block")
    placed = blocks.select(
        F.col("source"), "block", "words", F.coalesce(F.sum("words").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        (F.row_number().over(run) - 1).cast("long").alias("ordinal"), F.count("*").over(Window.partitionBy("source")).alias("n_blocks"),
    ).alias("b").join(sources.select("*", whole.alias("passes"), (F.floor("target").cast("long") - whole * F.col("source_size")).alias("rest")).alias("s"), F.expr("b.source <=> s.source")).drop(F.col("s.source"))
    placed = cut(placed)
    # A source's ends, one for each shard, tell where each of its blocks goes.
    ends = _leaves(placed, shards).groupBy("rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "end"))), lambda x: x["end"]).alias("ends"))
    dealt = placed.join(ends, "rank").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("ordinal"))).cast("int"))
    stretch = Window.partitionBy("source", "shard")
    exact = lambda c: c.cast("decimal(19,0)")
    upto = lambda words: F.when(F.col("source_size") > 0, F.floor(exact(F.col("rest")) * exact(words) / exact(F.col("source_size")))).otherwise(F.lit(0)).cast("long")
    dealt = dealt.withColumns({"first": F.min("before").over(stretch), "last": F.max(F.col("before") + F.col("words")).over(stretch)})
    # What a shard's partial pass takes of a source: its part of the rest, so that the parts sum to it.
    dealt = dealt.select("source", "block", "shard", "source_size", "target", "passes", (F.col("before") - F.col("first")).alias("before"), (upto(F.col("last")) - upto(F.col("first"))).alias("rest"))
    rows = blocked.alias("d").join(dealt.alias("k"), F.expr("d.source <=> k.source and d.block = k.block")).drop(F.col("k.source")).drop(F.col("k.block"))
    inner = Window.partitionBy("source", "block").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    partial = F.greatest(F.lit(0).cast("long"), F.least("size", F.col("rest") - F.col("before")))

    def draw(p):
        words = F.when(p < F.col("passes"), F.col("size")).otherwise(partial)
        return F.struct(F.col("shard").alias("shard"), p.cast("int").alias("pass"), words.cast("long").alias("words"), F.xxhash64(F.lit(SEED), F.col("shard"), F.col("doc_id"), p).alias("place"))

    draws = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes")), draw), lambda x: x["words"] > 0)
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda s, x: s + x["words"])
    return at.withColumn("draws", draws).select("doc_id", "h", "source", "size", "source_size", "target", "shard", taken.alias("taken"), "draws")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture: shard, place, doc_id, source, pass, words and the text drawn, each shard in its own order.

    A document that the mix draws twice gives two rows and one that it doesn't draw gives none. Where the partial pass ends
    within a document its first words are drawn, joined by spaces. Null texts and texts without words are never drawn;
    rows repeated with the same doc_id, text and source are drawn each for itself; an empty table gives an empty result.
    """
    same = Window.partitionBy("id", "none", "h", "source", "no_source").orderBy("order")
    doc, source = F.col("doc_id").cast("long"), F.col("source").cast("string")

    def named(rows: DataFrame, h: Column, order: Column, *columns: Column) -> DataFrame:
        key = (F.coalesce(doc, F.lit(0)).alias("id"), doc.isNull().alias("none"), h.alias("h"), F.coalesce(source, F.lit("")).alias("source"), source.isNull().alias("no_source"))
        return rows.select(*key, order.alias("order"), *columns).withColumn("copy", F.row_number().over(same)).drop("order")

    plan = mix_plan(docs, **options).filter("size > 0")
    drawn = named(plan, F.col("h"), F.to_json("draws"), F.col("size"), F.col("draws"))
    texts = named(docs, _text_hash(), F.lit(0), F.col("text").alias("text"))
    rows = texts.join(drawn, ["id", "none", "h", "source", "no_source", "copy"]).select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"), F.when(~F.col("no_source"), F.col("source")).alias("source"), "text", "size", F.inline("draws")
    )
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(SIZE), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    rows = rows.select("shard", "place", "doc_id", "source", "pass", "words", F.when(F.col("words") < F.col("size"), first).otherwise(F.col("text")).alias("text"))
    return rows.repartition("shard").sortWithinPartitions("shard", "place", "doc_id", "pass")
