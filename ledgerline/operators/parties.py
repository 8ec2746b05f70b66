"""Suppliers and jobs across systems: evidence for pairs, golden names, a crosswalk of every record, and review by entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import token_set
from .matching import band

#: A shop-floor job reference's written forms and scores; the first that matches decides. Fixed values.
JOB_FORMS = (
    ("exact", r"^J-(\d{2})-(\d{4})$", 100),
    ("case_normalised", r"^j-(\d{2})-(\d{4})$", 99),
    ("missing_hyphen", r"^[Jj](\d{2})-(\d{4})$", 97),
    ("missing_prefix", r"^(\d{2})-(\d{4})$", 96),
    ("zero_padding_restored", r"^[Jj]-(\d{2})-(\d{1,3})$", 95),
)


def evidence(pairs: DataFrame, records: DataFrame, invoiced: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with cross_system and support: the transactions that speak for the pair.

    records: key, system, code; invoiced: code, account, n, unique by code and account, with codes of one system and
    accounts of the other. A pair across systems has the n of its code and account; two codes share, for each account, the
    smaller n; two accounts share the codes they both serve. Pairs come from blocks, and each is joined by its code only.
    """
    side = lambda n: records.select(F.col("key").alias(n), F.col("system").alias(f"_s{n}"), F.col("code").alias(f"_c{n}"))
    both = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    served = invoiced.select("code", "account", "n")
    x, y = served.toDF("_ca", "_with", "_na"), served.toDF("_cb", "_with", "_nb")
    codes = both.join(x, "_ca").join(y, ["_cb", "_with"]).filter("_sa = _sb").groupBy("a", "b").agg(F.sum(F.least("_na", "_nb")).alias("n"))
    v, w = served.select(F.col("account").alias("_ca"), F.col("code").alias("_with")), served.select(F.col("account").alias("_cb"), F.col("code").alias("_with"))
    accounts = both.join(v, "_ca").join(w, ["_cb", "_with"]).filter("_sa = _sb").groupBy("a", "b").agg(F.count("*").alias("n"))
    crossed = both.filter("_sa <> _sb")
    forward, back = served.toDF("_ca", "_cb", "n"), served.toDF("_cb", "_ca", "n")
    across = crossed.join(forward, ["_ca", "_cb"]).select("a", "b", "n").unionAll(crossed.join(back, ["_ca", "_cb"]).select("a", "b", "n"))
    found = codes.unionByName(accounts).unionByName(across).groupBy("a", "b").agg(F.sum("n").alias("_n"))
    crossing = both.select("a", "b", (F.col("_sa") != F.col("_sb")).alias("cross_system"))
    return pairs.join(crossing, ["a", "b"]).join(found, ["a", "b"], "left").select(*(pairs[c] for c in pairs.columns), "cross_system", F.coalesce("_n", F.lit(0)).cast("long").alias("support"))


def golden_names(records: DataFrame, components: DataFrame, first: str) -> DataFrame:
    """entity_id, members, name and its system: the record of system ``first`` with most documents, else of any other; ties by code.

    records: key, system, code, name, documents; components: node, component.
    """
    rank = F.struct((F.col("system") != first).alias("o"), (-F.col("documents")).alias("d"), F.col("code").alias("c"), F.col("name").alias("name"), F.col("system").alias("system"))
    best = records.join(components, records["key"] == components["node"]).groupBy(F.col("component").alias("entity_id")).agg(F.count("*").alias("members"), F.min(rank).alias("_r"), F.count_if(F.col("system") == first).alias("n_first"))
    return best.select("entity_id", "members", F.col("_r.name").alias("name"), F.col("_r.system").alias("named_by"), "n_first", (F.col("members") - 1).alias("duplicates"))


def crosswalk(records: DataFrame, components: DataFrame, scored: DataFrame) -> DataFrame:
    """Every record: auto if its entity has a record of another system, review if its best pair across systems is, else unmatched.

    scored: a, b, score, status, cross_system. The best counterpart has the highest score, then the smallest key. Systems
    are few, so an entity is summarised by their number and not by its members.
    """
    tagged = records.join(components, records["key"] == components["node"]).select(*(records[c] for c in records.columns), F.col("component").alias("entity_id"))
    mixed = tagged.groupBy("entity_id").agg((F.count_distinct("system") > 1).alias("_mixed"))
    across = scored.filter("cross_system")
    ends = across.select(F.col("a").alias("key"), F.col("b").alias("other"), "score", "status").unionAll(across.select(F.col("b").alias("key"), F.col("a").alias("other"), "score", "status"))
    best = ends.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("o"), F.col("other").alias("other"), F.col("score").alias("score"), F.col("status").alias("status"))).alias("_b"))
    judged = F.when(F.col("_mixed"), "auto").when(F.col("_b.status") == "review", "review").otherwise("unmatched")
    return tagged.join(mixed, "entity_id").join(best, "key", "left").select("key", "entity_id", F.col("_b.other").alias("best_counterpart"), F.col("_b.score").alias("score"), judged.alias("status"))


def entity_queue(scored: DataFrame, components: DataFrame) -> DataFrame:
    """Pairs held for review as pairs of entities, so one decision settles them all: left, right, n_pairs, score, support, action.

    scored: a, b, score, status, support. Pairs within one entity need no decision.
    """
    left, right = components.toDF("a", "_l"), components.toDF("b", "_r")
    held = scored.filter("status = 'review'").join(left, "a").join(right, "b").filter("_l <> _r")
    one = held.groupBy(F.least("_l", "_r").alias("left_entity"), F.greatest("_l", "_r").alias("right_entity")).agg(F.count("*").alias("n_pairs"), F.max("score").alias("score"), F.max("support").alias("support"))
    return one.withColumn("action", F.when(F.col("support") > 0, "approve merge: invoices corroborate").otherwise("check VAT number, address and bank details"))


def likely_missed(scored: DataFrame) -> DataFrame:
    """Pairs across systems below the review floor that transactions speak for."""
    return scored.filter("status = 'unmatched' and cross_system and support > 0")


def by_method(rows: DataFrame) -> DataFrame:
    """Forms and the rows behind them by method and band; rows: method, status, n_rows."""
    return rows.groupBy("method", "status").agg(F.count("*").alias("n_forms"), F.sum("n_rows").alias("n_rows"))


def job_form(c: Column) -> Column:
    """struct(job_no, method, score) of a written job reference; unparsed scores 0."""
    bare = F.trim(c)
    out = F.struct(F.lit(None).cast("string").alias("job_no"), F.lit("unparsed").alias("method"), F.lit(0.0).alias("score"))
    for method, pattern, score in reversed(JOB_FORMS):
        job = F.concat(F.lit("J-"), F.regexp_extract(bare, pattern, 1), F.lit("-"), F.lpad(F.regexp_extract(bare, pattern, 2), 4, "0"))
        out = F.when(bare.rlike(pattern), F.struct(job.alias("job_no"), F.lit(method).alias("method"), F.lit(float(score)).alias("score"))).otherwise(out)
    return out


def finance_job(code: Column) -> Column:
    """``J-YY-NNNN`` of a finance code of 3 to 6 digits, else null."""
    rest = F.substring(code, 3, 6).try_cast("int").cast("string")
    return F.when(code.rlike(r"^\d{3,6}$"), F.concat(F.lit("J-"), F.substring(code, 1, 2), F.lit("-"), F.lpad(rest, 4, "0")))


def job_links(written: DataFrame, jobs: DataFrame, customers: DataFrame, floor: float = 80.0) -> DataFrame:
    """Written references to known jobs: written, n_rows, job_no (null if unmatched), method, score, agreement, status.

    written: written, customer, n_rows (customers normalised); jobs: job_no; customers: job_no, customer (normalised,
    unique by job_no). agreement is the row-weighted mean likeness of the customers written with the reference to the
    job's own; under ``floor`` the link scores 85 at most. Null without a customer to compare with.
    """
    read = written.withColumn("_f", job_form(F.col("written"))).withColumns({"job_no": F.col("_f.job_no"), "method": F.col("_f.method"), "score": F.col("_f.score")}).drop("_f")
    own = customers.select(F.col("job_no").alias("_job"), F.col("customer").alias("_own"))
    liked = read.join(own, read["job_no"] == own["_job"], "left").withColumn("_like", token_set(F.coalesce("customer", F.lit("")), F.col("_own")))
    one = liked.groupBy("written", "job_no", "method", "score").agg(F.sum("n_rows").alias("n_rows"), F.round(F.sum(F.col("_like") * F.col("n_rows")) / F.sum("n_rows"), 1).alias("agreement"))
    known = jobs.select(F.col("job_no").alias("_known")).distinct()
    found, low = F.col("_known").isNotNull(), F.coalesce(F.col("agreement") < floor, F.lit(False))
    method = F.when(F.col("job_no").isNull(), F.col("method")).when(~found, F.concat("method", F.lit("_not_found"))).when(low, F.concat("method", F.lit("+customer_disagrees"))).otherwise(F.col("method"))
    score = F.when(~found, 0.0).when(low, F.least("score", F.lit(85.0))).otherwise(F.col("score"))
    joined = one.join(known, one["job_no"] == known["_known"], "left").select("written", "n_rows", "job_no", method.alias("method"), score.alias("score"), F.when(found, F.col("agreement")).alias("agreement")).withColumn("status", band(F.col("score")))
    return joined.withColumn("job_no", F.when(F.col("status") != "unmatched", F.col("job_no")))


def job_crosswalk(jobs: DataFrame, finance: DataFrame, links: DataFrame) -> DataFrame:
    """One row for each job, and one for each finance code that derives no job: job_no, finance_job_code, in_finance, ops_reference_forms, ops_rows, in_ops, confidence and weakest_link.

    jobs: job_no; finance: code; links: the result of job_links(). A job's confidence is the least score of its accepted
    references, and its weakest link the method of the lowest of them (the first as written, of equals).
    """
    known = jobs.select("job_no").filter("job_no is not null").distinct()
    codes = finance.select("code", finance_job(F.col("code")).alias("job_no")).distinct()
    one = codes.filter("job_no is not null").groupBy("job_no").agg(F.min("code").alias("finance_job_code"))
    # A job is written in few ways; the rows behind them were counted before.
    refs = links.filter("status = 'auto'").groupBy("job_no").agg(
        F.array_join(F.array_sort(F.collect_set("written")), ", ").alias("_forms"), F.sum("n_rows").alias("_rows"), F.min("score").alias("_least"), F.min(F.struct("score", "written", "method"))["method"].alias("_method")
    )
    met = known.join(one, "job_no", "left").join(refs, "job_no", "left").select(
        "job_no", "finance_job_code", F.col("finance_job_code").isNotNull().alias("in_finance"), F.coalesce("_forms", F.lit("")).alias("ops_reference_forms"), F.coalesce("_rows", F.lit(0)).cast("long").alias("ops_rows"), F.col("_rows").isNotNull().alias("in_ops"),
        F.least(F.lit(100.0), "_least").alias("confidence"), F.coalesce("_method", F.lit("finance derived key")).alias("weakest_link"),
    )
    lost = codes.join(known, "job_no", "left_anti").select(F.lit(None).cast("string").alias("job_no"), F.col("code").alias("finance_job_code"), F.lit(True).alias("in_finance"), F.lit("").alias("ops_reference_forms"), F.lit(0).cast("long").alias("ops_rows"), F.lit(False).alias("in_ops"), F.lit(0.0).alias("confidence"), F.lit("no job").alias("weakest_link"))
    return met.unionByName(lost)


def unlinked(jobs: DataFrame, finance: DataFrame, links: DataFrame) -> DataFrame:
    """side, value and reason of all that is not linked: jobs that finance or the shop floor lacks, and what either writes in vain.

    jobs: job_no; finance: code; links: the result of job_links().
    """
    codes = finance.select("code", finance_job(F.col("code")).alias("job_no")).distinct()
    all_jobs = jobs.select("job_no").distinct()
    told = lambda df, side, value, reason: df.select(F.lit(side).alias("side"), F.col(value).alias("value"), F.lit(reason).alias("reason") if isinstance(reason, str) else reason.alias("reason"))
    auto = links.filter("status = 'auto'")
    held = F.when(F.col("status") == "review", F.concat(F.lit("held for review: "), F.col("method"))).otherwise(F.col("method"))
    return (
        told(all_jobs.join(codes, "job_no", "left_anti"), "jobs", "job_no", "no finance job code")
        .unionAll(told(all_jobs.join(auto, "job_no", "left_anti"), "jobs", "job_no", "no shop-floor delivery note"))
        .unionAll(told(codes.join(all_jobs, "job_no", "left_anti"), "finance", "code", "derived_key_not_found"))
        .unionAll(told(links.filter("status <> 'auto'"), "shop_floor", "written", held))
    )
