"""The stages after ingest, over published tables: matching, quality, reconciliation and marts.

A stage reads what is published, builds its tables aside, verifies them as they were written, and takes their place in the
manifest together. A stage that fails leaves the manifest, and so every reader, as it was. Each run, failed or not, is in the
history under ``stages``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise_name
from ..sources import publish as store
from . import allocation, marts, matching, materials, parties, quality, reconcile, traceability
from .components import checkpointed, connected_components, in_slices, shared_folder, stored
from .runs import run_id

#: Rows of receipts and issues that are allocated at a time, or of lines as received that are looked up, and the most slices that they are dealt into.
SLICE, SLICES = 500_000, 8


def _run(spark: SparkSession, root: str, stage: str, run: str | None, build: Callable[[str], tuple[dict[str, DataFrame | None], Callable]]) -> str:
    run, status = run or run_id(), "failed"
    try:
        tables, verify = build(run)
        store.publish(spark, root, run, tables, verify, stage)
        status = "succeeded"
    finally:
        store.append_history(spark.createDataFrame([(run, stage, status)], "run_id string, stage string, status string"), root, "stages", f"{run}-{stage}")
    return run


def _reader(spark: SparkSession, root: str) -> Callable[[str], DataFrame]:
    """Tables of one manifest, so a stage doesn't read a publication that comes while it runs."""
    version = store.manifest(spark, root)["version"]
    return lambda name: store.read_published(spark, root, name, version)


def _must(test: bool, text: str) -> None:
    if not test:
        raise AssertionError(text)


def _slices(rows: int) -> int:
    return min(SLICES, -(-rows // SLICE)) or 1


def _once(df: DataFrame, keys: list[str], name: str) -> None:
    again = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").first()
    _must(again is None, f"{name}: {again} stands more than once")


def run_match(spark: SparkSession, root: str, suffixes: list[str], abbreviations: dict[str, str], first: str, minutes: dict[str, float], auto: float = 95, review: float = 80, run: str | None = None) -> str:
    """Matches suppliers, jobs, works orders and materials, and publishes what is accepted, held for review and left over.

    Reads ``supplier_records`` (key, system, code, name, documents), ``supplier_invoices`` (code, account, n), ``jobs``
    (job_no), ``job_customers`` (job_no, customer), ``job_references`` (written, customer, n_rows), ``finance_codes`` (code),
    ``works_orders`` (number, job, site, start, finish), ``bookings`` (source, written, number, site, day, n), ``materials``
    (source_table, code, description, grade, section_type, uom, unit_weight) and ``section_catalogue`` (kind, dims, kg_per_m).

    Publishes supplier_pairs, supplier_entities, supplier_golden, supplier_crosswalk, supplier_review, job_links, job_crosswalk,
    job_unlinked, works_order_candidates, material_forms, material_golden, match_review_queue and match_quality. Every record
    and every form stands in its crosswalk once, or nothing is published.
    """

    def build(_run_id: str):
        read = _reader(spark, root)
        name = lambda c: normalise_name(F.col(c), suffixes, abbreviations)
        records = checkpointed(read("supplier_records").withColumn("normal", name("name")))
        invoiced = read("supplier_invoices")
        forms = records.select(F.col("key"), F.col("normal").alias("form")).filter("form <> ''")
        alike = matching.similar_pairs(forms, "key", "form", review).unionByName(matching.equal_names(forms, "key", "form"))
        scored = checkpointed(parties.evidence(alike, records, invoiced).withColumn("status", matching.band(F.col("score"), auto, review)))
        entities = checkpointed(connected_components(records.select(F.col("key").alias("node")), scored.filter("status = 'auto'")))
        crosswalk = parties.crosswalk(records.select("key", "system", "code"), entities, scored)
        queue = parties.entity_queue(scored, entities)

        customers = read("job_customers").withColumn("customer", name("customer"))
        links = checkpointed(parties.job_links(read("job_references").withColumn("customer", name("customer")), read("jobs"), customers, review))
        jobs = parties.job_crosswalk(read("jobs"), read("finance_codes"), links)

        known = read("works_orders")
        unknown = read("bookings").join(known.select("number").distinct(), "number", "left_anti")
        swaps = checkpointed(matching.transposition_evidence(unknown.groupBy("source", "written", "number").agg(F.collect_set("site").alias("sites"), F.min("day").alias("first_date"), F.max("day").alias("last_date"), F.sum("n").alias("n_rows")), known))

        catalogue = read("section_catalogue")
        resolved = checkpointed(materials.resolve(materials.forms([read("materials")]), catalogue))

        text = lambda c: F.col(c).cast("string")
        asked = lambda method, action: (F.lit(method).alias("method"), F.lit(action).alias("suggested_action"))
        held = {
            "supplier": queue.select(F.concat_ws("-", "left_entity", "right_entity").alias("item_id"), text("left_entity").alias("source_value"), text("right_entity").alias("proposed_match"), "score", F.lit("name").alias("method"), F.col("action").alias("suggested_action")),
            "job": links.filter("status = 'review'").select(F.col("written").alias("item_id"), F.col("written").alias("source_value"), F.col("job_no").alias("proposed_match"), "score", "method", F.lit("confirm the job").alias("suggested_action")),
            "works_order": swaps.select(F.concat_ws("-", "wrong", "candidate").alias("item_id"), F.col("written_as").alias("source_value"), text("candidate").alias("proposed_match"), "score", F.lit("adjacent_digit_transposition").alias("method"), "suggested_action"),
            "material": resolved.filter("status = 'review'").select(F.sha2(F.to_json(F.struct("source_table", *materials.WRITTEN)), 256).alias("item_id"), F.coalesce("code", "description").alias("source_value"), F.coalesce("proposed_code", "candidates").alias("proposed_match"), "score", "method", F.lit("confirm the material").alias("suggested_action")),
        }
        counted = {
            "supplier": crosswalk.select("status", F.lit(1).alias("n_rows")), "job": links.select("status", "n_rows"), "material": resolved.select("status", F.col("row_count").alias("n_rows")),
            "works_order": swaps.select(F.lit("review").alias("status"), "n_rows"),
        }
        figures = reduce(DataFrame.unionByName, [matching.quality(df, minutes[d]).withColumn("domain", F.lit(d)) for d, df in counted.items()])
        tables = {
            "supplier_pairs": scored, "supplier_entities": entities.toDF("key", "entity_id"), "supplier_golden": parties.golden_names(records, entities, first), "supplier_crosswalk": crosswalk, "supplier_review": queue,
            "job_links": links, "job_crosswalk": jobs, "job_unlinked": parties.unlinked(read("jobs"), read("finance_codes"), links), "works_order_candidates": swaps,
            "material_forms": resolved, "material_golden": materials.golden(resolved, catalogue), "match_review_queue": matching.combined_queue(held, minutes), "match_quality": figures,
        }

        def verify(written: dict[str, DataFrame]) -> None:
            _once(written["supplier_crosswalk"], ["key"], "supplier_crosswalk")
            _once(written["supplier_golden"], ["entity_id"], "supplier_golden")
            _once(written["job_crosswalk"].filter("job_no is not null"), ["job_no"], "job_crosswalk")
            _once(written["material_golden"], ["canonical_code"], "material_golden")
            _must(written["supplier_crosswalk"].count() == records.count(), "supplier_crosswalk lacks records")
            grouped = written["supplier_golden"].agg(F.sum("members").alias("n")).first().n or 0
            _must(grouped == records.count(), f"supplier_golden has {grouped} members")

        return tables, verify

    return _run(spark, root, "match", run, build)


def run_quality(spark: SparkSession, root: str, rules: list[quality.Rule], parameters: dict | None = None, run: str | None = None) -> str:
    """Evaluates ``rules`` over the published tables, by their names, and publishes dq_results, dq_exceptions, dq_rule and dq_index.

    The results are appended to the history under ``dq_results``, where they outlive the run. A rule that breaks is an error
    in its result. Exceptions that don't add up to the failures of the results stop the publication.
    """

    def build(run: str):
        quality.validate(rules)
        store.show(spark, root)
        found = quality.evaluate(spark, rules, parameters)
        listed = spark.createDataFrame([(r.id, r.name, r.dimension, r.severity, r.system, r.owner, float(r.threshold), r.action, ", ".join(map(str, r.covers))) for r in rules], "rule_id string, name string, dimension string, severity string, system string, owner string, threshold double, action string, covers string")
        actions = listed.select("rule_id", "action")
        results = stored(found.results)
        raised = quality.exceptions(found).join(F.broadcast(actions), "rule_id")

        def verify(written: dict[str, DataFrame]) -> None:
            _once(written["dq_results"], ["rule_id"], "dq_results")
            _must(written["dq_results"].count() == len(rules), "dq_results lacks rules")
            failed = written["dq_results"].agg(F.sum("failed").alias("n")).first().n or 0
            _must(failed == written["dq_exceptions"].count(), f"{failed} records fail, {written['dq_exceptions'].count()} are listed")
            store.append_history(written["dq_results"], root, "dq_results", run)

        return {"dq_results": results, "dq_exceptions": raised, "dq_rule": listed, "dq_index": quality.index(results)}, verify

    return _run(spark, root, "quality", run, build)


def run_reconcile(spark: SparkSession, root: str, as_of: str, exempt: tuple[str, ...] = (), stock_tolerance: float = 0.02, run: str | None = None) -> str:
    """Reconciles purchases, job costs, stock and material, and publishes their rows, their headlines and their exposures.

    Reads ``order_lines`` (order_id and what reconcile.three_way needs), ``invoices`` (line_id, po_no, nominal, amount,
    invoiced_on), ``cost_lines`` (job, side planned or actual, component material or labour, amount), ``stock_counts`` (item,
    site, book, counted), ``receipts`` (key, supply_id, at, quantity, grade, heat_number, mill_cert_ref), ``issues``
    (key, demand_id, job, at, deadline, quantity, unconfirmed, finished, despatched, execution_class, grade) and ``job_sales``
    (job, customer, sales_value). The ids of receipts and of issues are unique over all keys.

    Publishes three_way_lines, three_way_summary, three_way_ageing, job_cost, stock_lines, allocations, traced_lines,
    trace_jobs, trace_breaks, trace_receipts, headline and exposure. Every headline is computed again from its table as written; one that isn't found
    there stops the publication.
    """

    def build(run: str):
        read = _reader(spark, root)
        built = lambda name, df: store.built(spark, root, run, name, df)
        lines, orders = read("order_lines"), read("order_lines").select(F.col("order_id").alias("po_no"))
        lost = reconcile.without_order(read("invoices"), orders, exempt)
        match = built("three_way_lines", reconcile.both_sides(reconcile.three_way(lines, as_of), lost, "order_id", "line_id"))
        age = F.datediff(F.lit(as_of).cast("date"), "exception_date")
        ageing = match.filter("exception_date is not null").groupBy("category", reconcile.age_bucket(age).alias("bucket")).agg(F.count("*").alias("n_rows"), F.sum("value_at_risk").alias("total"))
        costs = built("job_cost", reconcile.gaps(read("cost_lines"), ["job"], "side", ("planned", "actual"), "component", ("material", "labour"), "amount"))
        difference = F.col("counted") - F.col("book")
        stock = built("stock_lines", read("stock_counts").withColumns({"difference": difference, "accurate": ~reconcile.beyond(difference.cast("double"), F.abs(F.col("book").cast("double")) * stock_tolerance)}))
        issues, receipts = read("issues"), read("receipts")
        slices = _slices(receipts.count() + issues.count())

        def met(of: Callable) -> DataFrame:
            out = allocation.fifo_with_deadline(of(receipts, "key").select("key", "supply_id", "at", "quantity"), of(issues, "key").select("key", "demand_id", "at", "deadline", "quantity"), "key")
            return out.select("key", F.col("supply_id").alias("receipt_id"), F.col("demand_id").alias("line_id"), F.col("allocated").alias("kg")).sortWithinPartitions("key", "line_id")

        # Rows that stand in order take up less.
        allocated = store.built_in_slices(spark, root, run, "allocations", slices, met)
        needs = issues.select("key", F.col("demand_id").alias("line_id"), "job", F.col("quantity").cast("double").alias("kg"), "unconfirmed", "finished", "despatched", "execution_class", "grade")
        papers = receipts.select("key", F.col("supply_id").alias("receipt_id"), "heat_number", "mill_cert_ref")
        traced = store.built_in_slices(spark, root, run, "traced_lines", slices, lambda of: traceability.traced(traceability.coverage(*(of(df, "key").drop("key") for df in (needs, allocated, papers)))).sortWithinPartitions("line_id"))
        shown = built("trace_receipts", traceability.receipts_shown(receipts))
        by_job = built("trace_jobs", traceability.jobs(traced, read("job_sales")))
        breaks = traced.groupBy("break_at").agg(F.count("*").alias("n_lines"), F.sum("kg").alias("kg"))
        figures = [
            *reconcile.exception_headlines("three_way_lines", match, as_of),
            *reconcile.headlines("job_cost", "job_cost", costs, [("gross_gap", "true", "round(sum(abs(gap)), 2)"), ("net_gap", "true", "round(sum(gap), 2)"), ("jobs_over", "gap > 0", "count(*)"), ("jobs_under", "gap < 0", "count(*)")]),
            *reconcile.headlines("stock", "stock_lines", stock, [("gross_error", "true", "round(sum(abs(difference)), 2)"), ("net_adjustment", "true", "round(sum(difference), 2)"), ("lines", "true", "count(*)"), ("accurate_lines", "accurate", "count(*)")]),
            *(h for name, df in (("traced_lines", traced), ("trace_jobs", by_job), ("trace_receipts", shown)) for h in reconcile.headlines("traceability", name, df, traceability.HEADLINES[name])),
        ]
        exposed = {"three_way": "value_at_risk", "job_cost": "gross_gap", "stock": "gross_error", "traceability": "exposed_kg"}
        listed = spark.createDataFrame([(i, h.engine, h.key, float(h.value), h.table, h.value_sql, h.rows_sql) for i, h in enumerate(figures, 1)], "ordinal int, engine string, key string, value double, table string, value_sql string, rows_sql string")
        exposure = spark.createDataFrame([(h.engine, h.key, float(h.value)) for h in figures if exposed[h.engine] == h.key], "engine string, label string, exposure double")
        tables = {
            **dict.fromkeys(("three_way_lines", "job_cost", "stock_lines", "allocations", "traced_lines", "trace_jobs", "trace_receipts")), "three_way_summary": reconcile.summary(match, "category", reconcile.CATEGORIES, "value_at_risk"),
            "three_way_ageing": ageing, "trace_breaks": breaks, "headline": listed, "exposure": exposure,
        }

        def verify(written: dict[str, DataFrame]) -> None:
            for name in {h.table for h in figures}:
                written[name].createOrReplaceTempView(name)
            reconcile.verify(spark, figures)

        return tables, verify

    return _run(spark, root, "reconcile", run, build)


def lines_behind(spark: SparkSession, root: str, engine: str, key: str, received: str = "raw_lines") -> DataFrame:
    """From a published figure to the lines as received: the rows that its own query gives, by the files and lines they carry, in the published table ``received``.

    They are looked up by slices of files and lines, and stored outside ``root``.
    """
    read = _reader(spark, root)
    head = read("headline").filter((F.col("engine") == engine) & (F.col("key") == key)).first()
    if head is None:
        raise KeyError(f"no figure {engine}.{key} is published")
    read(head["table"]).createOrReplaceTempView(head["table"])
    rows, lines = spark.sql(head["rows_sql"]), read(received)
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    return in_slices(spark, path, _slices(lines.count()), lambda of: reconcile.raw_behind(*(of(df, *reconcile.ORIGIN) for df in (rows, lines))))


def build_marts(spark: SparkSession, root: str, views: dict[str, str], kpis: list[marts.Kpi], helpers: dict[str, str] | None = None, run: str | None = None) -> str:
    """Builds the views (name to SQL, in order) over the published tables, in a database of the run with their descriptions, and publishes kpi_scorecard, kpi_definition and mart_views.

    The views' comments are read back from the catalogue; one that nobody described stops the publication, and the run's
    database goes. ``mart_views`` names the database, so readers of a manifest find the views that belong to it.
    """
    made: list[str] = []

    def build(run: str):
        comments = marts.described(views, kpis, helpers)
        marts.validate(spark, kpis)
        database = "marts_" + "".join(c if c.isalnum() else "_" for c in run).lower()
        made.append(database)
        store.expose(spark, root, database)
        own = store.create_views(spark, database, views, comments)
        scores = checkpointed(marts.scorecard(own, kpis))
        listed = store.introspected(spark, database).filter("kind = 'view'").select("name", "comment", "n_columns", F.lit(database).alias("database"))

        def verify(written: dict[str, DataFrame]) -> None:
            store.assert_described(spark, database, comments)
            _once(written["kpi_scorecard"], ["kpi"], "kpi_scorecard")
            _must(written["kpi_scorecard"].count() == len(kpis), "kpi_scorecard lacks KPIs")

        return {"kpi_scorecard": scores, "kpi_definition": marts.definitions(spark, kpis), "mart_views": listed}, verify

    try:
        return _run(spark, root, "marts", run, build)
    except BaseException:
        for database in made:
            spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")
        raise
