"""The stages: what each replaces, what a failure leaves, and what readers see."""

import datetime
import glob
import os
import random

import duckdb
import pyarrow.parquet
import pytest
from pyspark.sql import functions as F

from ledgerline.functions.similarity import pair_score
from ledgerline.operators import allocation, components, marts, matching, quality, reconcile, stages, traceability
from ledgerline.plans import bindings
from ledgerline.sources import publish

DAY = datetime.date
CAVEAT = "word " * 20


@pytest.fixture
def root(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    yield at
    publish.delete(spark, at)


def test_a_stage_keeps_the_tables_of_others(spark, root):
    publish.publish(spark, root, "r1", {"a": spark.range(1), "b": spark.range(2)}, stage="one")
    publish.publish(spark, root, "r2", {"c": spark.range(3)}, stage="two")
    publish.publish(spark, root, "r3", {"a": spark.range(4)}, stage="one")
    assert {n: t["run"] for n, t in publish.manifest(spark, root)["tables"].items()} == {"a": "r3", "c": "r2"}
    assert publish.read_published(spark, root, "a").count() == 4 and publish.read_published(spark, root, "b", 2).count() == 2
    with pytest.raises(KeyError, match="b isn't published"):
        publish.read_published(spark, root, "b")
    with pytest.raises(ValueError, match="belong to two"):
        publish.publish(spark, root, "r4", {"c": spark.range(1)}, stage="one")
    assert publish.clear(spark, root, keep=1) == ["r1"] and publish.read_published(spark, root, "c").count() == 3


def test_of_two_publications_from_one_manifest_the_second_fails(spark, root):
    publish.publish(spark, root, "r1", {"a": spark.range(1)}, stage="one")

    def meanwhile(_):
        publish.publish(spark, root, "r3", {"b": spark.range(1)}, stage="two")

    with pytest.raises(publish.PublishedMeanwhile):
        publish.publish(spark, root, "r2", {"a": spark.range(9)}, meanwhile, "one")
    assert {n: t["run"] for n, t in publish.manifest(spark, root)["tables"].items()} == {"a": "r1", "b": "r3"}


def test_readers_are_not_served_an_old_version(spark, root):
    publish.publish(spark, root, "r1", {"a": spark.range(3)}, stage="one")
    reader = publish.Reader(spark, root, size=2)
    ask = lambda k: reader.query("SELECT count(*) AS n FROM a WHERE id >= :k", {"k": k}).first()["n"]
    assert [ask(0), ask(1), ask(0)] == [3, 2, 3] and reader.hits == 1
    assert ask(2) == 1 and ask(1) == 2 and reader.hits == 1 and len(reader.kept) == 2
    publish.publish(spark, root, "r2", {"a": spark.range(10)}, stage="one")
    assert ask(1) == 9 and reader.hits == 1


RULES = [quality.Rule("DQ-01", "a", "validity", "low", "s", "o", 0.5, "SELECT id AS record_key, id % 4 <> 0 AS passed, id AS observed FROM a", "look at it")]


def test_quality_is_published_with_its_exceptions_or_not_at_all(spark, root, monkeypatch):
    publish.publish(spark, root, "r1", {"a": spark.range(8)}, stage="core")
    stages.run_quality(spark, root, RULES, run="q1")
    read = lambda t: publish.read_published(spark, root, t)
    assert read("dq_results").select("checked", "failed", "met").collect() == [(8, 2, True)]
    assert sorted((r.record_key, r.action) for r in read("dq_exceptions").collect()) == [("0", "look at it"), ("4", "look at it")]
    before = publish.manifest(spark, root)
    monkeypatch.setattr(quality, "exceptions", lambda e: e.checks.select("rule_id", F.lit(1).alias("place"), "record_key", "observed", F.lit("").alias("severity"), F.lit("").alias("owner")))
    with pytest.raises(AssertionError, match="2 records fail, 8 are listed"):
        stages.run_quality(spark, root, RULES, run="q2")
    assert publish.manifest(spark, root) == before
    runs = {(r.run_id, r.status) for r in spark.read.parquet(f"{root}/history/stages").drop("run").collect()}
    assert runs == {("q1", "succeeded"), ("q2", "failed")}
    assert spark.read.parquet(f"{root}/history/dq_results").count() == 1


def test_marts_are_views_with_comments_or_not_built(spark, root):
    publish.publish(spark, root, "r1", {"a": spark.range(8)}, stage="core")
    spark.range(3).createOrReplaceTempView("a")  # which the views must not see
    kpi = marts.Kpi("K", "n", "Finance Manager", CAVEAT, "abs_lower", "v2", "-count(*)", 4.0, views={"v1": "all's there", "v2": "even ones"})
    views = {"v1": "SELECT * FROM a", "v2": "SELECT * FROM v1 WHERE id % 2 = 0"}
    stages.build_marts(spark, root, views, [kpi], run="m1")
    assert publish.read_published(spark, root, "kpi_scorecard").collect() == [("K", "n", "Finance Manager", -4.0, 4.0, "on target")]
    listed = publish.read_published(spark, root, "mart_views").collect()
    assert {(r.name, r.comment) for r in listed} == {("v1", "all's there"), ("v2", "even ones")} and spark.table(f"{listed[0].database}.v2").count() == 4
    before = publish.manifest(spark, root)
    with pytest.raises(ValueError, match="built but not described"):
        stages.build_marts(spark, root, views | {"v3": "SELECT 1 AS x"}, [kpi], run="m2")
    with pytest.raises(Exception, match="nowhere"):
        stages.build_marts(spark, root, {"v1": "SELECT * FROM a", "v2": "SELECT * FROM nowhere"}, [kpi], run="m3")
    assert publish.manifest(spark, root) == before and not spark.catalog.databaseExists("marts_m3")


def test_every_problem_of_a_definition_is_told(spark):
    wrong = [marts.Kpi("A", "", "Nobody", "short", "sideways", "v", "count(*)"), marts.Kpi("B", "n", "Finance Manager", CAVEAT, "band", "v", "count(*)", low=1.0), marts.Kpi("B", "n", "Finance Manager", CAVEAT, "lower", "v", "count(*)")]
    found = {(r.id, r.problem) for r in marts.problems(marts.definitions(spark, wrong)).collect()}
    assert found == {("A", "no name"), ("A", "a caveat has 20 words"), ("A", "owner isn't known"), ("A", "direction isn't known"), ("B", "id is used twice"), ("B", "no band"), ("B", "no target")}
    with pytest.raises(ValueError, match="no KPI"):
        marts.validate(spark, [])
    spark.createDataFrame([(-2.0, 5.0), (3.0, None)], "x double, y double").createOrReplaceTempView("judged")
    told = [marts.Kpi(i, "n", "Finance Manager", CAVEAT, d, "judged", a, 2.0, 0.0, 1.0) for i, d, a in (("a", "abs_lower", "min(x)"), ("b", "abs_lower", "max(x)"), ("c", "none", "max(x)"), ("d", "lower", "max(y) FILTER (WHERE x > 0)"), ("e", "band", "min(x)"), ("f", "higher", "max(x)"))]
    assert {r.kpi: r.status for r in marts.scorecard(spark, told).collect()} == {"a": "on target", "b": "off target", "c": "for information", "d": "no data", "e": "off target", "f": "on target"}


def test_similar_pairs_are_all_that_score_the_floor(spark):
    rng = random.Random(4)
    words = ["NORTH", "NORTHERN", "STEEL", "STEELS", "TUBE", "TUBES", "AND", "SECTION", "SECTIONS", "A", "AB", "SUPPLY", "BRIDGE", "BRIDGES"]
    names = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(160)} | {"A", "B", "AA", "", "AAAA AAA", "AAA AAAA"})
    df = spark.createDataFrame(list(enumerate(names)) + [(900, "STEEL"), (901, None)], "id long, name string")
    for floor, block in ((80, True), (70, False), (95, False)):
        found = {(r.a, r.b): r.score for r in matching.similar_pairs(df, "id", "name", floor, block).collect()}
        want = {(i, j): s for i, x in enumerate(names) for j, y in enumerate(names) if i < j and (not block or x.split(" ")[0] == y.split(" ")[0]) and (s := pair_score(x, y)) >= floor}
        assert found == want
    assert matching.similar_candidates(df, "id", "name", 95, False).count() < len(names) ** 2 / 20


def test_matching_is_published_whole(spark, root):
    row = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "supplier_records": row([("m:1", "m", "1", "Mersey Tube Ltd", 5), ("f:A", "f", "A", "MERSEY TUBE", 2), ("m:2", "m", "2", "Mersey Tubes", 1), ("f:B", "f", "B", "Other Co", 1)], "key string, system string, code string, name string, documents long"),
        "supplier_invoices": row([("1", "A", 3), ("2", "A", 1)], "code string, account string, n long"),
        "jobs": row([("J-24-0001",), ("J-24-0002",)], "job_no string"), "job_customers": row([("J-24-0001", "Acme")], "job_no string, customer string"),
        "job_references": row([("J-24-0001", "ACME", 3), ("j24-0001", "ACME", 2), ("24-0002", None, 1), ("what", "X", 1)], "written string, customer string, n_rows long"),
        "finance_codes": row([("241",), ("249",)], "code string"),
        "works_orders": row([(12345, "J-24-0001", "N", DAY(2024, 1, 1), DAY(2024, 3, 1))], "number long, job string, site string, start date, finish date"),
        "bookings": row([("t", "12354", 12354, "N", DAY(2024, 1, 9), 4), ("t", "12345", 12345, "N", DAY(2024, 1, 9), 4)], "source string, written string, number long, site string, day date, n int"),
        "materials": row([("bom", "203x133x25UB", None, "S355J0", "UB", "M", 25.1), ("stock", "UB 203X133X25", "", "", None, "KG", None), ("stock", "?", "odd", None, None, None, None)], "source_table string, code string, description string, grade string, section_type string, uom string, unit_weight double"),
        "section_catalogue": row([("UB", "203X133X25", 25.1)], "kind string, dims string, kg_per_m double"),
    }
    publish.publish(spark, root, "c", tables, stage="core")
    arguments = (["LTD", "CO"], {}, "m", {"supplier": 6, "job": 3, "works_order": 5, "material": 4})
    stages.run_match(spark, root, *arguments, run="m1")
    read = lambda t: publish.read_published(spark, root, t)
    assert {r.key: r.status for r in read("supplier_crosswalk").collect()} == {"m:1": "auto", "f:A": "auto", "m:2": "auto", "f:B": "unmatched"}
    walked = {(r.job_no, r.finance_job_code): (r.ops_reference_forms, r.ops_rows, r.confidence, r.weakest_link) for r in read("job_crosswalk").collect()}
    assert walked == {("J-24-0001", "241"): ("J-24-0001, j24-0001", 5, 97.0, "missing_hyphen"), ("J-24-0002", None): ("24-0002", 1, 96.0, "missing_prefix"), (None, "249"): ("", 0, 0.0, "no job")}
    assert {(r.domain, r.source_value, r.proposed_match) for r in read("match_review_queue").collect()} == {("works_order", "12354", "12345"), ("material", "UB 203X133X25", "UB203X133X25-S355J0")}
    assert {r.domain: (r.forms, r.auto, r.review) for r in read("match_quality").collect()} == {"supplier": (4, 3, 0), "job": (4, 3, 0), "works_order": (1, 0, 1), "material": (3, 1, 1)}
    before = publish.manifest(spark, root)
    publish.publish(spark, root, "c2", {**tables, "supplier_records": tables["supplier_records"].unionAll(tables["supplier_records"].limit(1))}, stage="core")
    with pytest.raises(AssertionError, match="more than once"):
        stages.run_match(spark, root, *arguments, run="m2")
    after = publish.manifest(spark, root)["tables"]
    assert {n for n, t in after.items() if t["stage"] == "match"} == {n for n, t in before["tables"].items() if t["stage"] == "match"} and after["match_quality"]["run"] == "m1"


def test_rules_of_a_table_are_one_scan_and_know_their_lines(spark, tmp_path):
    rows = [(k, k % 3, "f.csv", k + 2) for k in range(9)]
    spark.createDataFrame(rows, "id int, g int, _source_file string, _source_row int").write.parquet(f"{tmp_path}/t")
    spark.read.parquet(f"{tmp_path}/t").createOrReplaceTempView("fusable")
    rule = lambda i, check: quality.Rule(i, i, "validity", "low", "s", "o", 1.0, check)
    rules = [
        rule("A", quality.predicate("fusable", "id", "id < ${most}", "id")), rule("B", quality.not_null("fusable", "id", "g")), rule("C", quality.unique("fusable", "g")), rule("D", quality.one_value("fusable", "g", "id")),
        rule("E", quality.predicate("fusable", "id", "no_such > 1")), rule("F", quality.predicate("fusable", "id", "${unknown} > 1")),
    ]
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in quality.fused(spark, rules[:4], {"most": 7})]
    assert len(plans) == 2 and all(p.count("Relation") == 1 for p in plans)
    found = quality.evaluate(spark, rules, {"most": 7})
    assert {r.rule_id: (r.status, r.checked, r.failed) for r in found.results.collect()} == {"A": ("ok", 9, 2), "B": ("ok", 9, 0), "C": ("ok", 3, 3), "D": ("ok", 3, 3), "E": ("error", 0, 0), "F": ("error", 0, 0)}
    listed = quality.exceptions(found).filter("rule_id = 'A'").orderBy("place").collect()
    assert [(r.record_key, r.observed, r.source_file, r.source_row) for r in listed] == [("7", "7", "f.csv", 9), ("8", "8", "f.csv", 10)]
    assert found.checks.filter("rule_id = 'C'").select("observed", "source_row").distinct().collect() == [("3", None)]


def held(spark):
    """Bytes in the shared folder."""
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(components.shared_folder(spark)) for f in files)


@pytest.mark.parametrize("name", ["stage_quality", "headline_rows"])
def test_stages_leave_their_result_alone_on_disk(spark, name):
    """Nothing of what a stage stores outlives its query but the rows that this gives, and these are columns, not rows as in memory."""
    before = held(spark)
    n = bindings.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert held(spark) - before < 20_000 + 60 * n


def test_only_records_that_fail_are_stored(spark):
    spark.range(1000).createOrReplaceTempView("many")
    rules = [quality.Rule(i, i, "validity", "low", "s", "o", 1.0, check) for i, check in (("A", quality.predicate("many", "id", "id <> 7", "id")), ("B", quality.predicate("many", "id", "id >= 0")), ("C", "SELECT id AS record_key, id < 998 AS passed, NULL AS observed FROM many"), ("D", quality.predicate("many", "id", "CAST(concat('x', id) AS INT) > 0")))]
    found = quality.evaluate(spark, rules)
    assert {r.rule_id: (r.status, r.checked, r.failed) for r in found.results.collect()} == {"A": ("ok", 1000, 1), "B": ("ok", 1000, 0), "C": ("ok", 1000, 2), "D": ("error", 0, 0)}
    assert sorted((r.rule_id, r.record_key) for r in found.failing.collect()) == [("A", "7"), ("C", "998"), ("C", "999")]
    assert found.checks.count() == 3000


def test_what_is_released_is_gone_and_what_outlives_it_stays(spark):
    before = held(spark)
    with components.released(spark) as outer:
        aside = components.stored(spark.range(1000))
        kept = components.stored(aside.groupBy((F.col("id") % 7).alias("k")).count(), outer)
        assert held(spark) > before
    assert kept.agg(F.sum("count")).first()[0] == 1000
    assert held(spark) - before < 10_000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_material_is_allocated_and_traced_in_slices(spark, monkeypatch):
    """No allocation sees all receipts and issues, and every figure is as in SQL."""
    sizes, whole = [], allocation.fifo_with_deadline

    def counted(supply, demand, key):
        sizes.append(supply.count() + demand.count())
        return whole(supply, demand, key)

    monkeypatch.setattr(allocation, "fifo_with_deadline", counted)
    monkeypatch.setattr(stages, "SLICE", 3500, raising=False)
    found = {(r.engine, r.key): r.value for r in bindings.QUERIES["stage_headlines"](spark, "/root/testdata/sf0.001").collect()}
    assert len(sizes) >= 2 and max(sizes) < 0.75 * sum(sizes)
    sql = duckdb.connect()
    for t in ("orders", "lineitem", "customer", "part", "supplier"):
        sql.execute(f"CREATE VIEW {t} AS FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    assert found == {(e, k): pytest.approx(v, abs=1e-6) for e, k, v in sql.execute(bindings.ORACLES["stage_headlines"]).fetchall()}


def test_lines_as_received_are_published_when_the_stage_is_done(spark, monkeypatch):
    names, publication = [], publish.publish

    def listed(spark, root, run, tables, *others, **named):
        names.append(list(tables))
        return publication(spark, root, run, tables, *others, **named)

    monkeypatch.setattr(publish, "publish", listed)
    bindings.QUERIES["headline_raw_lines"](spark, "/root/testdata/sf0.001").count()
    assert names[-1] == ["raw_lines"] and "raw_lines" not in names[0]


def test_tables_that_are_retained_are_all_that_is_left(spark, root):
    publish.publish(spark, root, "r1", {"a": spark.range(1), "b": spark.range(2)}, stage="one")
    publish.publish(spark, root, "r2", {"c": spark.range(3)}, stage="two")
    with pytest.raises(KeyError):
        publish.retain(spark, root, "b", "d")
    assert set(publish.manifest(spark, root)["tables"]) == {"a", "b", "c"}
    publish.retain(spark, root, "b")
    assert publish.manifest(spark, root)["tables"] == {"b": {"run": "r1", "stage": "one"}} and publish.versions(spark, root) == [3]
    assert publish.read_published(spark, root, "b").count() == 2 and glob.glob(f"{root.removeprefix('file://')}/run=*/*") == [f"{root.removeprefix('file://')}/run=r1/b"]


def test_what_the_lookup_of_lines_does_not_read_goes_before_they_are_published(spark, monkeypatch):
    """And lines are published in order, in which they take up less."""
    left, rising, publication = [], [], publish.publish

    def seen(spark, root, run, tables, *others, **named):
        at = root.removeprefix("file://")
        if "raw_lines" in tables:
            left.extend(sorted(os.path.basename(d) for d in glob.glob(f"{at}/run=*/*")))
        publication(spark, root, run, tables, *others, **named)
        for name in {"raw_lines", "invoices"} & set(tables):
            for f in glob.glob(f"{at}/run={run}/{name}/*.parquet"):
                rows = pyarrow.parquet.ParquetFile(f).read(["_source_file", "_source_row"]).to_pylist()
                rising.append([tuple(r.values()) for r in rows] == sorted(tuple(r.values()) for r in rows))

    monkeypatch.setattr(publish, "publish", seen)
    bindings.QUERIES["headline_raw_lines"](spark, "/root/testdata/sf0.001").count()
    assert left == ["headline", "three_way_lines"] and len(rising) >= 2 and all(rising)


def test_lines_are_looked_up_in_slices(spark, monkeypatch):
    """No lookup sees all lines, and those found are as in SQL."""
    sizes, whole = [], reconcile.raw_behind

    def counted(rows, received):
        sizes.append(received.count())
        return whole(rows, received)

    monkeypatch.setattr(reconcile, "raw_behind", counted)
    monkeypatch.setattr(stages, "SLICE", 2000)
    found = sorted(tuple(r) for r in bindings.QUERIES["headline_raw_lines"](spark, "/root/testdata/sf0.001").collect())
    assert len(sizes) >= 3 and max(sizes) < 0.5 * sum(sizes)
    sql = duckdb.connect()
    for t in ("orders", "lineitem", "customer", "part", "supplier"):
        sql.execute(f"CREATE VIEW {t} AS FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    assert found == sorted(sql.execute(bindings.ORACLES["headline_raw_lines"]).fetchall())


def test_a_slice_of_lines_is_traced_with_its_own_receipts(spark, monkeypatch):
    sizes, whole = [], traceability.coverage

    def counted(lines, allocations, receipts):
        sizes.append(receipts.count())
        return whole(lines, allocations, receipts)

    monkeypatch.setattr(traceability, "coverage", counted)
    monkeypatch.setattr(stages, "SLICE", 2000)
    bindings.QUERIES["stage_headlines"](spark, "/root/testdata/sf0.001").count()
    every = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").filter("l_linestatus = 'F'").select("l_orderkey", "l_linenumber", "l_partkey").distinct().count()
    assert len(sizes) >= 2 and sum(sizes) == every and max(sizes) < 0.75 * every
