"""Entity matching: bands, blocked pairs, evidence, golden records, crosswalks and review queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.similarity import best_pair_score
from ..functions.text import transpositions
from .components import connected_components
from .numbering import numbered


def band(score: Column, auto: float = 95, review: float = 80) -> Column:
    """auto, review or unmatched; null is unmatched."""
    return F.when(score >= auto, "auto").when(score >= review, "review").otherwise("unmatched")


def block_pairs(names: DataFrame, key: str, name: str) -> DataFrame:
    """Unordered pairs that share their first word: a, b, name_a, name_b. Equal names meet once, through their first key."""
    forms = names.groupBy(F.col(name).alias("n")).agg(F.min(key).alias("k")).withColumn("block", F.split("n", " ")[0])
    left, right = forms.select(F.col("k").alias("a"), F.col("n").alias("name_a"), "block"), forms.select(F.col("k").alias("b"), F.col("n").alias("name_b"), "block")
    return left.join(right, "block").filter("a < b").drop("block")


def similar_candidates(names: DataFrame, key: str, name: str, floor: float = 80, block: bool = True) -> DataFrame:
    """Unordered pairs a, b of distinct names that may score ``floor`` or more, with the names; all that do are among them.

    The score is the better Indel ratio of two forms: sorted words, and no spaces. If a ratio is t, both strings have at least
    t / (2 - t) of the other's length, and share at least (1.5 t - 1) of both lengths, less one, of their pairs of neighbouring
    characters. So one of the rarest pairs of each, as many as may be missing and one more, is common to both, and names meet
    by these alone; strings too short to say so meet by a common mark. ``block``: only names with the same first word.
    """
    if floor < 70:
        raise ValueError("a floor under 70 leaves no pair of characters that similar names must share")
    t = (floor - 0.05) / 100  # scores are rounded
    least, near = (1.5 * t - 1) * (1 + t / (2 - t)), t / (2 - t)
    short = int(1 / least + 1e-9) / near
    words = F.filter(F.split("n", r"\s+"), lambda w: w != "")
    forms = names.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("n")).agg(F.min(key).alias("k"))
    ways = F.array(F.struct(F.lit(0).alias("form"), F.array_join(F.array_sort(words), " ").alias("s")), F.struct(F.lit(1).alias("form"), F.array_join(words, "").alias("s")))
    strings = forms.select("k", "n", (F.split("n", " ")[0] if block else F.lit("")).alias("block"), F.explode(ways).alias("w")).select("k", "block", "w.form", "w.s", F.length("w.s").alias("n_chars"))
    pairs = F.when(F.col("n_chars") > 1, F.transform(F.sequence(F.lit(1), F.col("n_chars") - 1), lambda i: F.substring(F.col("s"), i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    # The second time that a pair stands in a string it is another token, so sharing is counted as often as it is there.
    counted = strings.withColumn("g", pairs).withColumn("tokens", F.transform("g", lambda g, at: F.concat(g, F.size(F.filter(F.slice("g", F.lit(1), at), lambda x: x == g)).cast("string"))))
    tokens = counted.select("k", "block", "form", "n_chars", F.explode("tokens").alias("token"))
    rare = tokens.groupBy("form", "token").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("k", "form").orderBy("df", "token"))
    kept = F.col("n_chars") - 1 - F.greatest(F.ceil(F.col("n_chars") * least - 1 - 1e-9), F.lit(1)) + 1
    prefix = tokens.join(rare, ["form", "token"]).withColumn("place", place).filter(F.col("place") <= kept).select("k", "block", "form", "n_chars", "token")
    marked = strings.filter(F.col("n_chars") <= short).select("k", "block", "form", "n_chars", F.lit("").alias("token"))
    index = prefix.unionByName(marked)
    left, right = index.withColumnsRenamed({"k": "a", "n_chars": "_n"}), index.withColumnsRenamed({"k": "b", "n_chars": "_m"})
    met = left.join(right, ["form", "block", "token"]).filter((F.col("a") < F.col("b")) & (F.least("_n", "_m") >= F.greatest("_n", "_m") * near - 1e-9)).select("a", "b").distinct()
    return met.join(forms.toDF("name_a", "a"), "a").join(forms.toDF("name_b", "b"), "b").select("a", "b", "name_a", "name_b")


def similar_pairs(names: DataFrame, key: str, name: str, floor: float = 80, block: bool = True) -> DataFrame:
    """The pairs of similar_candidates() that do score ``floor`` or more, with their score."""
    return similar_candidates(names, key, name, floor, block).withColumn("score", best_pair_score("name_a", "name_b")).filter(F.col("score") >= floor)


def equal_names(names: DataFrame, key: str, name: str) -> DataFrame:
    """Each key but the first of those with one name, linked to the first: a, b, name_a, name_b and score 100. A link a key, not a pair of each two."""
    forms = names.groupBy(F.col(name).alias("name_a")).agg(F.min(key).alias("a"), F.count("*").alias("_same")).filter("_same > 1").drop("_same")
    return names.select(F.col(key).alias("b"), F.col(name).alias("name_b")).join(forms, F.col("name_a") == F.col("name_b")).filter("a <> b").select("a", "b", "name_a", "name_b", F.lit(100.0).alias("score"))


def score_pairs(pairs: DataFrame, auto: float = 95, review: float = 80) -> DataFrame:
    return pairs.withColumn("score", best_pair_score("name_a", "name_b")).withColumn("status", band(F.col("score"), auto, review))


def golden(records: DataFrame, key: str, name: str, weight: str, pairs: DataFrame) -> DataFrame:
    """entity_id, members, golden_name (of the weightiest record, then the first name), total weight; pairs a, b are accepted links."""
    found = connected_components(records.select(F.col(key).alias("node")), pairs)
    tagged = records.join(found, records[key] == found["node"]).select(F.col("component").alias("entity_id"), F.col(name).alias("n"), F.col(weight).alias("w"))
    return tagged.groupBy("entity_id").agg(F.count("*").alias("members"), F.min(F.struct((-F.col("w")).alias("o"), F.col("n").alias("n")))["n"].alias("golden_name"), F.sum("w").alias("total_weight"))


def crosswalk(forms: DataFrame, known: DataFrame, form_key: str, known_key: str, score: str) -> DataFrame:
    """Every form with whether it is known, its confidence (0 if unknown) and its band: nothing is guessed."""
    one = known.select(F.col(known_key).alias("_k")).distinct()
    joined = forms.join(one, forms[form_key] == one["_k"], "left")
    return joined.withColumn("confidence", F.when(F.col("_k").isNotNull(), F.col(score)).otherwise(0)).withColumn("status", band(F.col("confidence"))).drop("_k")


def transposition_queue(unknown: DataFrame, known: DataFrame, number: str, known_number: str) -> DataFrame:
    """(wrong number, candidate) with the rows behind it: known numbers one swap of neighbouring digits away."""
    counted = unknown.filter(F.col(number).isNotNull()).groupBy(F.col(number).cast("bigint").alias("wrong")).agg(F.count("*").alias("n_rows"))
    swapped = counted.withColumn("candidate", F.explode(transpositions(F.col("wrong"))))
    one = known.select(F.col(known_number).cast("bigint").alias("candidate")).distinct()
    return swapped.join(one, "candidate").select("wrong", "candidate", "n_rows", F.lit(85).alias("score"))


#: How sure a swap of two digits is, and what a person is asked to do about it.
SWAPPED, LIKELY, WEAK = 85, "likely keying error: confirm and correct the record", "weak candidate: ask who made the record"


def transposition_evidence(unknown: DataFrame, known: DataFrame, days: int = 30) -> DataFrame:
    """One row for each wrong number and known number a swap away, with the evidence of all its spellings.

    ``unknown`` has source, written, number, sites (an array), first_date, last_date, n_rows; ``known`` has number, job, site,
    start, finish, unique by number. site_matches is null where no spelling names a site; dates_in_window says whether some
    spelling's dates lie within ``days`` of the candidate's. Spellings and sources are sorted and comma-joined.
    """
    swapped = unknown.filter("number is not null").withColumn("candidate", F.explode(transpositions(F.col("number").cast("bigint"))))
    facts = known.select(F.col("number").cast("bigint").alias("candidate"), "job", F.col("site").alias("_site"), "start", "finish")
    met = swapped.join(facts, "candidate")
    site = F.when(F.size("sites") > 0, F.coalesce(F.array_contains("sites", F.col("_site")), F.lit(False)))
    inside = F.coalesce((F.col("first_date") >= F.date_sub("start", days)) & (F.col("last_date") <= F.date_add("finish", days)), F.lit(False))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    # The spellings of a number are few; its rows were counted before.
    items = met.groupBy(F.col("number").cast("bigint").alias("wrong"), "candidate").agg(
        listed("written").alias("written_as"), listed("source").alias("sources"), F.min("job").alias("job"), F.sum("n_rows").alias("n_rows"),
        F.bool_or(site).alias("site_matches"), F.bool_or(inside).alias("dates_in_window"),
    )
    likely = F.coalesce("site_matches", F.lit(False)) & F.col("dates_in_window")
    return items.select("*", F.lit(SWAPPED).alias("score"), F.when(likely, LIKELY).otherwise(WEAK).alias("suggested_action"))


QUEUE = ("item_id", "source_value", "proposed_match", "score", "method", "suggested_action", "est_minutes")


def combined_queue(domains: dict[str, DataFrame], minutes: dict[str, float]) -> DataFrame:
    """The review queues of all domains in one, each with its domain and the minutes an item of it takes; columns by name."""
    parts = [df.withColumn("est_minutes", F.lit(float(minutes[name]))).select(F.lit(name).alias("domain"), F.col("item_id").cast("string").alias("item_id"), F.col("source_value").cast("string").alias("source_value"), F.col("proposed_match").cast("string").alias("proposed_match"), F.col("score").cast("double").alias("score"), *QUEUE[4:]) for name, df in domains.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def quality(rows: DataFrame, minutes: float) -> DataFrame:
    """Of (status, n_rows) forms: counts by band, share accepted by form and by row, and minutes of review."""
    n = lambda s: F.count_if(F.col("status") == s)
    return rows.agg(
        F.count("*").alias("forms"), n("auto").alias("auto"), n("review").alias("review"), n("unmatched").alias("unmatched"),
        (n("auto") / F.count("*")).alias("auto_share"), (F.sum(F.when(F.col("status") == "auto", F.col("n_rows")).otherwise(0)) / F.sum("n_rows")).alias("auto_row_share"), (n("review") * minutes).alias("review_minutes"),
    )


def review_queue(scored: DataFrame, key: list[str]) -> DataFrame:
    """What needs a person, best first, numbered."""
    return numbered(scored.filter("status = 'review'"), [F.col("score").desc(), *key])
