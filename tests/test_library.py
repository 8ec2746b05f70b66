"""The library against DuckDB on the given tables, and its functions against known values and brute force."""

import hashlib
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ledgerline.functions import similarity, text
from ledgerline.operators import allocation, components, conformance, governance, joins, marts, numbering, parties, profiling, provenance, quality, reconcile, reports, runs, staging, yields
from ledgerline.plans import bindings
from ledgerline.plans import staging as bound
from ledgerline.sources import config, publish, raw
from ledgerline.sources.contracts import Column, ContractViolation, TableContract
from ledgerline.streaming import ingest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for f in os.listdir(SF):
        out.sql(f"CREATE VIEW {f.split('.')[0]} AS FROM '{SF}/{f}'")
    return out


@pytest.mark.parametrize("name", sorted(bindings.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = bindings.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    if name in bindings.ORACLES:
        found = con.sql(bindings.ORACLES[name])
        assert sorted(found.columns) == columns
        assert got == sorted((tuple(r[found.columns.index(c)] for c in columns) for r in found.fetchall()), key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def one(spark, expression, *values):
    return spark.createDataFrame([(v,) for v in values], "c string").select(expression(F.col("c")).alias("x")).collect()


def test_text_functions(spark):
    assert [r.x for r in one(spark, text.coerce_number, "£ 1,234.50", "7,5", "1,23,456", "-3", "8 hrs")] == ["1234.50", None, None, "-3", None]
    assert [r.x for r in one(spark, text.job_reference, "J24-0871", "J-24-871", "24-0871", "j-24-0871", "x")] == ["J-24-0871"] * 4 + [None]
    assert [tuple(r.x) for r in one(spark, text.works_order_form, "12345 (rev B)", "WO 12345", "wo-12345", "no")] == [(12345, "B", "revision_suffix", 97), (12345, None, "wo_prefix", 99), (12345, None, "wo_prefix", 99), (None, None, "unparsed", 0)]
    assert [tuple(r.x) for r in one(spark, text.works_order_form, "12345  (rev  b)", " 12345 ", "see 12345!", "123456")] == [(12345, "B", "revision_suffix", 97), (12345, None, "bare_number", 100), (12345, None, "embedded_number", 85), (None, None, "unparsed", 0)]
    assert [r.x.kind for r in one(spark, text.designation, "PLATE 1 2", "20 PLATE", "OLD ANGLE 75X75X8", "UB203X133", "12mm PLATE", "PLATE 12MM S355J2", "UNEQUAL ANGLE 150x90x10", "ub 203 x 133 x 25", None)] == [None, None, None, None, "PLATE", "PLATE", "L", "UB", None]
    assert [tuple(r.x) for r in one(spark, text.designation, "203x133x25UB", "UNIV BEAM 203X133X25", "UB 203x133x25 S355J2", "PLT12-S355J2", "PLATE12", "PL12MM", "L75X75X8-S355JO", "bolt")] == [("UB", "203X133X25", None)] * 2 + [("UB", "203X133X25", "S355J2"), ("PLATE", "12", "S355J2"), ("PLATE", "12", None), ("PLATE", "12", None), ("L", "75X75X8", "S355J0"), (None, None, None)]
    assert [r.x for r in one(spark, lambda c: text.parse_date(c, ["%d/%m/%Y", "%d-%b-%y"]), "1/2/2025", "31/02/2025", "05-Mar-25", "TBC")] == [__import__("datetime").date(2025, 2, 1), None, __import__("datetime").date(2025, 3, 5), None]
    assert [r.x for r in one(spark, text.strip, "\u00a0a \t", None)] == ["a", None]
    assert one(spark, lambda c: text.transpositions(c.cast("int")), "1223")[0].x == [2123, 1232]


def test_similarity():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = 0
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], old + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 30))) for _ in range(2))
        assert similarity.lcs(a, b) == slow(a, b)
    assert similarity.pair_score("MERSEY TUBE", "MERSEY TUBE AND SECTION") == 66.7
    assert similarity.token_set_ratio("A B", "B A C") == 100.0


def test_fifo_without_deadline_equals_greedy(spark):
    rng = random.Random(3)
    rows = [(k, i, i, float(rng.randint(0, 9))) for k in range(8) for i in range(12)]
    supply = spark.createDataFrame(rows, "k long, supply_id long, at long, quantity double")
    demand = spark.createDataFrame([(k, i, at, float(rng.randint(0, 9))) for k, i, at, _ in rows], "k long, demand_id long, at long, quantity double")
    plain = {(r.k, r.supply_id, r.demand_id): r.allocated for r in allocation.fifo(supply, demand, "k", ["at"], ["at"]).collect()}
    late = allocation.fifo_with_deadline(supply, demand.withColumn("deadline", F.lit(99)), "k").collect()
    assert plain == {(r.k, r.supply_id, r.demand_id): r.allocated for r in late} and plain
    none = allocation.fifo_with_deadline(supply, demand.withColumn("deadline", F.lit(-1)), "k")
    assert none.count() == 0


def test_components(spark):
    nodes = spark.range(30).withColumnRenamed("id", "node")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(19)] + [(25, 22), (25, 29)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(nodes, pairs).collect()}
    assert got == {i: 0 if i < 20 else 22 if i in (22, 25, 29) else i for i in range(30)}


def test_staging_invariants(spark):
    judged = staging.judge(bound.raw(spark, SF), bound.CONTRACT)
    kept, out, total = staging.staged(judged, bound.CONTRACT).count(), staging.quarantine(judged).count(), bound.raw(spark, SF).count()
    staging.assert_balanced(total, kept, out)
    steps = staging.lineage(judged).orderBy("step").collect()
    assert steps[0].rows_in == total and steps[-1].rows_out == kept
    assert all(a.rows_out == b.rows_in for a, b in zip(steps, steps[1:], strict=False)) and all(s.rows_in == s.rows_out + s.rows_rejected for s in steps)
    with pytest.raises(AssertionError):
        staging.assert_balanced(3, 1, 1)
    assert {r.anomaly for r in profiling.anomalies(bound.raw(spark, SF), bound.CONTRACT).collect()} >= {"padding", "not a number", "unreadable date"}


CONTRACT = TableContract("a", "t", (Column("id", "integer", required=True, key=True), Column("note")))


def test_raw_extract(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(b'# extract\nid,note\n1,"two\nlines"\n2,\n3,a,b\n# no comment,x\n')
    good, ragged, files = raw.read_raw(spark, f"{tmp_path}/t.csv", CONTRACT)
    assert [(r.id, r.note, r._source_row) for r in good.orderBy("_source_row").collect()] == [("1", "two\nlines", 4), ("2", "", 5), ("# no comment", "x", 7)]
    assert [r._source_row for r in ragged.collect()] == [6] and files.count() == 1
    (tmp_path / "u.csv").write_bytes(b"id,other\n")
    with pytest.raises(ContractViolation):
        raw.read_raw(spark, f"{tmp_path}/u.csv", CONTRACT)


def test_publication_keeps_the_last_good_run(spark, tmp_path):
    root, df = f"file://{tmp_path}/w", spark.range(3)
    assert publish.current(spark, root) is None
    publish.publish(spark, root, "r1", {"t": df})

    def refuse(_):
        raise AssertionError

    with pytest.raises(AssertionError):
        publish.publish(spark, root, "r2", {"t": df.limit(1)}, refuse)
    assert publish.current(spark, root) == "r1" and publish.read_published(spark, root, "t").count() == 3
    publish.publish(spark, root, "r3", {"t": df.limit(1)})
    assert publish.read_published(spark, root, "t").count() == 1


def test_streaming_ingest_reads_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write = lambda n, *lines: (tmp_path / "in" / n).write_text("\n".join(lines))
    run = lambda: ingest.ingest_available(spark, f"{tmp_path}/in", f"{tmp_path}/out", CONTRACT, f"{tmp_path}/cp")
    write("a.json", '{"id":"1","note":"x","_source_file":"a","_source_row":1}', '{"id":"q","note":"x","_source_file":"a","_source_row":2}')
    run()
    run()
    write("b.json", '{"id":"1","note":"again","_source_file":"b","_source_row":1}')
    run()
    staged = spark.read.parquet(f"{tmp_path}/out/staged")
    assert staged.count() == 2 and spark.read.parquet(f"{tmp_path}/out/quarantine").count() == 1
    assert [r.note for r in ingest.latest(staged, ["id"]).collect()] == ["x"]


def test_quality_rules_are_validated():
    good = quality.Rule("A", "a", "validity", "low", "s", "o", 1.0, "SELECT 1")
    with pytest.raises(ValueError, match="severity.*threshold.*used twice"):
        quality.validate([quality.Rule("A", "a", "validity", "dire", "s", "o", 2.0, "SELECT 1"), good])
    with pytest.raises(ValueError, match="unknown parameters"):
        quality.substituted("${a} ${b}", {"a": 1})


def test_headlines_and_marts_refuse_what_does_not_add_up(spark):
    spark.range(5).createOrReplaceTempView("five")
    reconcile.verify(spark, [reconcile.Headline("e", "k", 5, "five", "true", "count(*)")])
    with pytest.raises(AssertionError, match="e.k"):
        reconcile.verify(spark, [reconcile.Headline("e", "k", 4, "five", "true", "count(*)")])
    with pytest.raises(ValueError, match="built but not described"):
        marts.build(spark, {"v": "SELECT 1"}, [])


def test_tolerance_edges(spark):
    row = spark.range(1).select(reconcile.beyond(F.lit(5.0), F.lit(5.0)).alias("on"), reconcile.beyond(F.lit(-5.1), F.lit(5.0)).alias("over"), *(reconcile.age_bucket(F.lit(d)).alias(f"b{d}") for d in (0, 30, 31, 181))).first()
    assert tuple(row) == (False, True, "0-30 days", "0-30 days", "31-60 days", "over 180 days")


def test_pence_are_rounded_as_in_sql(spark):
    """Half pence lie below or above their digits as doubles; the reasons round them as the SQL does."""
    amounts = [f"{k}.{c:02}5" for k in (1, 8, 70976, 156558, 19735) for c in range(0, 100, 7)]
    lines = spark.sql("SELECT stack({}, {}) AS billed".format(len(amounts), ", ".join(f"'{a}'" for a in amounts))).selectExpr(
        "billed", "CAST(1 AS DECIMAL(12,2)) AS ordered", "CAST(1 AS DECIMAL(12,2)) AS received", "CAST(999999 AS DECIMAL(12,2)) AS received_value", "CAST(billed AS DECIMAL(18,6)) AS invoiced", "CAST(1 AS DECIMAL(12,2)) AS order_value",
        "DATE '2001-01-01' AS promised", "DATE '2001-01-01' AS received_on", "DATE '2001-01-10' AS invoiced_on")
    told = {r.billed: r.reason for r in reconcile.three_way(lines, "2001-06-01").collect()}
    for a in amounts:
        want = duckdb.connect().execute(f"SELECT '£' || printf('%,.2f', round(CAST(CAST({a} AS DECIMAL(18,6)) AS DOUBLE), 2))").fetchone()[0]
        assert told[a].startswith(f"invoiced {want} against"), (a, told[a])


def test_joins_keep_rows(spark):
    child = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "i int, k string")
    parent = spark.createDataFrame([("a", 9), ("a", 8), (None, 7)], "k2 string, v int")
    got = joins.matched(child, parent, {"k": "k2"}, "hit", ["v"]).orderBy("i").collect()
    assert [(r.i, r.v, r.hit) for r in got] == [(1, 8, True), (2, None, False), (3, None, False)]


def test_provenance():
    assert provenance.attribute(["1", "2", "2", "9"], [("2", "b"), ("1", "a"), ("2", "c")]) == ["a", "c", "b", None]


def test_identifiers_are_no_figures(spark):
    df = spark.createDataFrame([(1, "on 2024-03-01, DQ-12 and J-24-0871: 5 of 1,200"), (2, None), (3, "EN 1090-2 clause 5.2, 3 March 2025, phases 1, 2 and 3; 7.5")], "id int, text string")
    assert sorted((r.id, r.token) for r in provenance.figure_tokens(df, "id", "text").collect()) == [(1, "1,200"), (1, "5"), (3, "7.5")]
    assert {(r.id, r.kind): r.n for r in provenance.structure(df, "id", "text").collect()} == {(1, "date"): 1, (1, "rule"): 1, (1, "job"): 1, (3, "standard"): 1, (3, "clause"): 1, (3, "date"): 1, (3, "phase"): 1}


def test_config(spark, tmp_path):
    (tmp_path / "c.csv").write_text("# note\nkind,designation,kg_per_m\nUB,203x133x25,25.1\n")
    assert config.catalogue(spark, f"{tmp_path}/c.csv").first().designation == "203X133X25"
    with pytest.raises(ValueError):
        config.aliases(spark, {"A": ["x"], "B": ["X"]})


def test_job_references_are_linked_or_listed(spark):
    jobs = spark.createDataFrame([("J-24-0001",), ("J-24-0002",), ("J-24-0003",)], "job_no string")
    customers = spark.createDataFrame([("J-24-0001", "ACME STEEL"), ("J-24-0002", "NORTH BRIDGES")], "job_no string, customer string")
    written = spark.createDataFrame(
        [("J-24-0001", "ACME STEEL", 3), ("j24-0001", None, 1), ("24-0002", "ZZZ", 2), ("J-24-3", "ANY", 1), ("J-24-0009", "ACME STEEL", 1), ("no job", "X", 1), (None, None, 1)], "written string, customer string, n_rows long"
    )
    links = parties.job_links(written, jobs, customers)
    got = {r.written: (r.job_no, r.method, r.score, r.status) for r in links.collect()}
    assert got == {
        "J-24-0001": ("J-24-0001", "exact", 100.0, "auto"), "j24-0001": ("J-24-0001", "missing_hyphen+customer_disagrees", 85.0, "review"), "24-0002": ("J-24-0002", "missing_prefix+customer_disagrees", 85.0, "review"),
        "J-24-3": ("J-24-0003", "zero_padding_restored", 95.0, "auto"), "J-24-0009": (None, "exact_not_found", 0.0, "unmatched"), "no job": (None, "unparsed", 0.0, "unmatched"), None: (None, "unparsed", 0.0, "unmatched"),
    }
    finance = spark.createDataFrame([("241",), ("240002",), ("249",)], "code string")
    listed = {(r.side, r.value, r.reason) for r in parties.unlinked(jobs, finance, links).collect()}
    assert {("jobs", "J-24-0003", "no finance job code"), ("jobs", "J-24-0002", "no shop-floor delivery note"), ("finance", "249", "derived_key_not_found"), ("shop_floor", "24-0002", "held for review: missing_prefix+customer_disagrees")} <= listed
    assert len(listed) == 8


def test_evidence_within_and_across_systems(spark):
    records = spark.createDataFrame([("a", "m", "m1"), ("b", "m", "m2"), ("c", "f", "f1"), ("d", "f", "f2")], "key string, system string, code string")
    invoiced = spark.createDataFrame([("m1", "f1", 3), ("m2", "f1", 2), ("m2", "f2", 7)], "code string, account string, n long")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "d"), ("a", "d")], "a string, b string")
    assert {(r.a, r.b): (r.cross_system, r.support) for r in parties.evidence(pairs, records, invoiced).collect()} == {("a", "b"): (False, 2), ("a", "c"): (True, 3), ("c", "d"): (False, 1), ("a", "d"): (True, 0)}


def test_designations(spark):
    values = ["203x133x25UB S355JO", "Universal Beam 203 x 133 x 25", "20mm PLATE S275 JR", "Unequal Angle 100x75x8 S355NL", "CHS 100", "BOLT-M16", "", None]
    got = [tuple(r.x) for r in one(spark, text.designation, *values)]
    assert got == [("UB", "203X133X25", "S355J0"), ("UB", "203X133X25", None), ("PLATE", "20", "S275JR"), ("L", "100X75X8", "S355NL"), (None, None, None), (None, None, None), (None, None, None), (None, None, None)]


def test_reports(spark):
    table = spark.createDataFrame([("a|b", 1), (None, 2)], "x string, y int")
    shown = reports.markdown(table)
    assert reports.markdown_rows(f"text\n\n{shown}\nmore", "| x") == [["a|b", "1"], ["", "2"]] and reports.markdown_rows(shown, "| z") == []
    table.createOrReplaceTempView("reported")
    values = reports.figures(spark, {"n": ("SELECT count(*) FROM reported", reports.count), "m": ("SELECT -1234.5D", reports.pounds)})
    assert reports.fill("{{n}} rows, {{ m }}", values) == "2 rows, -£1,234.50" and reports.percent(0.1234) == "12.3%"
    with pytest.raises(ValueError, match="no value"):
        reports.fill("{{n}} {{q}}", {"n": "1"})
    with pytest.raises(ValueError, match="not one figure"):
        reports.figures(spark, {"n": ("SELECT y FROM reported", str)})
    with pytest.raises(ValueError, match="more than"):
        reports.markdown(table, most=1)


def test_upserts_and_slices(spark, tmp_path):
    old, new = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int"), spark.createDataFrame([(9, "b"), (8, None), (7, "c")], "v int, k string")
    assert {(r.k, r.v) for r in publish.upserted(old, new, ["k"]).collect()} == {("a", 1), ("b", 9), (None, 8), ("c", 7)}
    publish.replace_slices(old.filter("k is not null"), f"{tmp_path}/s", "k")
    publish.replace_slices(new.filter("k = 'b'"), f"{tmp_path}/s", "k")
    assert {(r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/s").collect()} == {("a", 1), ("b", 9)}


def test_fingerprint_coverage_and_trend(spark):
    files = spark.createDataFrame([("b", "2"), ("a", "1")], "path string, sha256 string")
    assert quality.fingerprint(files) == hashlib.sha256(b"12").hexdigest()
    rules = [quality.Rule("A", "a", "validity", "low", "s", "o", 1.0, "SELECT 1 AS record_key, false AS passed, 1 AS observed", covers=(1, 2)), quality.Rule("B", "b", "validity", "low", "s", "o", 1.0, "SELECT 1 AS record_key, true AS passed, 1 AS observed", covers=(2,))]
    results = quality.evaluate(spark, rules).results
    assert {(r.defect, r.rules, r.failed) for r in quality.defect_coverage(spark, rules, [1, 2, 3], results).collect()} == {(1, "A", 1), (2, "A, B", 1), (3, "", 0)}
    runs = results.withColumn("run", F.lit(1)).unionAll(results.withColumns({"score": F.lit(1.0), "run": F.lit(2)}).select(*results.columns, "run"))
    assert [r.change for r in quality.trend(runs).orderBy("run").collect()] == [None, 50.0]


def test_numbers_over_partitions(spark):
    df = spark.range(500).select((F.col("id") * 37 % 101).alias("x"), (F.col("id") % 3).alias("g"), "id")
    got = [(r.x, r.id) for r in numbering.numbered(df, [F.col("x").desc(), "id"]).orderBy("place").collect()]
    assert got == sorted(got, key=lambda r: (-r[0], r[1])) and len(got) == 500
    by_group = numbering.numbered(df, ["x", "id"], group=["g"]).collect()
    for g in range(3):
        own = sorted((r.place, r.x, r.id) for r in by_group if r.g == g)
        assert [p for p, _, _ in own] == list(range(1, len(own) + 1)) and [x[1:] for x in own] == sorted(x[1:] for x in own)
    assert [r.id for r in numbering.identified(spark.range(2).withColumnRenamed("id", "n"), ["n"], "Q-", 4).orderBy("n").collect()] == ["Q-0001", "Q-0002"]


def test_extracts_split_within_quoted_cells(spark, tmp_path):
    """Records keep their cells and physical lines however the file is split."""
    rng, lines, expected = random.Random(5), [], []
    for i in range(300):
        note = rng.choice(["plain", "", 'a "b", c', "two\nlines", "x\n\n,y\nz"])
        lines.append(f'{i},"{note.replace(chr(34), chr(34) * 2)}"')
        expected.append((str(i), note, 2 + "\n".join(lines).count("\n") + 1))
    (tmp_path / "t.csv").write_bytes(("# c\nid,note\n" + "\n".join(lines) + "\n").encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        good, ragged, files = raw.read_raw(spark, f"{tmp_path}/t.csv", CONTRACT)
        assert sorted((r.id, r.note, r._source_row) for r in good.collect()) == sorted(expected) and ragged.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.comment, r.rows_received, r.rows_ragged) for r in files.collect()] == [("# c", 300, 0)]


def test_figures_are_attributed_within_their_scope(spark):
    tokens = spark.createDataFrame([("p", 0, "1"), ("p", 1, "2"), ("q", 0, "2"), (None, 0, "5")], "page string, place int, token string")
    ledger = spark.createDataFrame([("p", 0, "2", "b"), ("p", 1, "1", "a"), ("p", 2, "2", "c"), (None, 9, "5", None)], "page string, place int, text string, origin string")
    # The figure 1 is followed by 2, as its entry is, and the last 2 by nothing, as the entry c is.
    assert {(r.page, r.place): r.origin for r in provenance.attributed(tokens, ledger, "page").collect()} == {("p", 0): "a", ("p", 1): "c", ("q", 0): None, (None, 0): None}
    assert provenance.attributed(tokens.limit(0), ledger, "page").count() == 0
    assert [r.origin for r in provenance.attributed(tokens, ledger.limit(0), "page").collect()] == [None] * 4


def test_attribution_equals_a_walk_and_gives_each_entry_once(spark):
    rng = random.Random(12)
    said = {s: [str(rng.randrange(4)) for _ in range(n)] for s, n in (("hot", 300), ("b", 20), ("c", 1))}
    book = {s: [(t, f"{s}{k}") for k, t in enumerate(texts) if k % 7 != 3] + [("9", "spare"), ("1", "late")] for s, texts in said.items()}

    def walk(texts, entries):
        after = lambda xs, k: xs[k + 1] if k + 1 < len(xs) else None
        words, out, used = [t for t, _ in entries], {}, set()
        for sees in (lambda xs, k: (xs[k], after(xs, k)), lambda xs, k: xs[k]):
            waiting = {}
            for k in range(len(words)):
                if k not in used:
                    waiting.setdefault(sees(words, k), []).append(k)
            for k in range(len(texts)):
                if k not in out and waiting.get(sees(texts, k)):
                    out[k] = waiting[sees(texts, k)].pop(0)
            used |= set(out.values())
        return [entries[out[k]][1] if k in out else None for k in range(len(texts))]

    tokens = spark.createDataFrame([(s, k, t) for s, texts in said.items() for k, t in enumerate(texts)], "page string, place int, token string")
    ledger = spark.createDataFrame([(s, k, t, o) for s, entries in book.items() for k, (t, o) in enumerate(entries)], "page string, place int, text string, origin string")
    got = {}
    for r in provenance.attributed(tokens.repartition(5), ledger.repartition(3), "page").collect():
        got.setdefault(r.page, {})[r.place] = r.origin
    for s, texts in said.items():
        assert [got[s][k] for k in range(len(texts))] == walk(texts, book[s])
        for t in set(texts):
            assert sum(got[s][k] is not None for k, x in enumerate(texts) if x == t) == min(texts.count(t), sum(x == t for x, _ in book[s]))


def test_bars_for_pieces(spark):
    rows = [(1, "UB", "M", 10, 2500, 100, 6000), (2, "PLATE", "M", 10, 2500, 1, 6000), (3, "UB", "EA", 10, 2500, 7, 6000), (4, "UB", "M", 10, 7000, 1, 6000), (5, "UC", "M", 1, 6000, 30, 6000), (6, "UB", "M", None, 2500, 5, 6000), (7, None, "M", 5, 2500, 2, 6000)]
    lines = spark.createDataFrame(rows, "id int, section_type string, uom string, qty int, length_mm int, kg int, bar_length_mm int")
    cut = {r.id: (r.pieces, r.pieces_per_bar, r.bars, r.used_m, r.bought_m, r.offcut_m, r.bought_kg) for r in yields.cut_lines(lines).collect()}
    assert cut == {1: (4, 2, 2, 10.0, 12.0, 2.0, 120.0), 5: (0, 1, 0, 0.0, 0.0, 0.0, None), 6: (None, 2, None, None, None, None, None)}
    receipts = spark.createDataFrame([("a", 3, "KG"), ("a", 2, "M"), ("b", 2, "EA"), ("c", 1, "M"), ("gone", 5, "KG"), ("a", 9, "BOX")], "material_code string, qty int, uom string")
    xref = spark.createDataFrame([("a", "U1", None, None), ("b", None, "U2", "U1"), ("c", None, None, "U3, U1")], "source_code string, canonical_code string, proposed_code string, candidates string")
    golden = spark.createDataFrame([("U1", "UB", 10.0, 4.0), ("U2", "UB", 1.0, 50.0), ("U3", "UC", 6.0, 1.0)], "canonical_code string, section_type string, mass double, kg_per_ea double")
    received = yields.received_weight(receipts, xref, golden)
    assert sorted((r.material_code, r.section_type, r.kg) for r in received.collect() if r.kg is not None) == [("a", "UB", 3.0), ("a", "UB", 20.0), ("b", "UB", 100.0), ("c", "UC", 6.0), ("gone", None, 5.0)]
    by = {r.section_type: r for r in yields.by_section(lines, received).collect()}
    assert set(by) == {"UB", "PLATE", "UC", None}
    ub = by["UB"]
    assert (ub.bom_lines, ub.cut_used_kg, ub.cut_bought_kg, ub.issued_kg, ub.received_kg, ub.received_to_issued) == (2, 105.0, 120.0, 113.0, 123.0, 1.09)
    assert by["PLATE"].bom_lines is None and by["PLATE"].received_kg is None and by["UC"].cut_yield_pct is None


def test_governance_over_empty_and_unknown(spark):
    results = spark.createDataFrame([("A", "critical", None, "x"), ("A", "low", False, "y"), ("B", "high", True, "x")], "owner string, severity string, met boolean, system string")
    found, scored = spark.createDataFrame([("A", "low", "R1"), ("A", "high", "R2"), ("C", "low", "R1")], "owner string, severity string, rule_id string"), spark.createDataFrame([], "owner string, status string")
    assert sorted(map(tuple, governance.ownership(results, found, scored).collect())) == [("A", 2, 1, 1, 2, 0, 0), ("B", 1, 0, 0, 0, 0, 0)]
    assert sorted(map(tuple, governance.rules_by_system(results, ["x", "y", "z"]).collect())) == [("A", 1, 1, 0), ("B", 1, 0, 0)]
    assert governance.chosen(found).count() == 3 and governance.chosen(found, ("A",), (), ("R2",)).count() == 1 and governance.chosen(found, ("A",), ("none",)).count() == 0
    steps = spark.createDataFrame([("ST-02", 9, 8, 1), ("ST-02", 5, 5, 0), ("XX-01", 1, 1, 0)], "rule string, rows_in long, rows_out long, rows_rejected long")
    ran = {r.rule: (r.layer, r.rows_in, r.rows_rejected) for r in governance.activity(governance.catalogue(spark), [steps]).collect()}
    assert ran["ST-02"] == ("staging", 14, 1) and ran["RC-01"] == ("reconciliation", None, None) and ran["XX-01"] == (None, 1, 0) and len(ran) == 27
    forms = spark.createDataFrame([(1, "1", 2, "bare", None), (1, "WO 1", 1, "prefix", None), (1, "1", 3, "bare", None), (2, "2", 9, "bare", 2), (None, "?", 4, "unparsed", None)], "parsed_number int, source_value string, row_count int, matched_on string, wo_no int")
    assert sorted((tuple(r) for r in governance.unresolved(forms).collect()), key=str) == [(1, "1, WO 1", 6, "bare"), (None, "?", 4, "unparsed")]


def test_conformance_keeps_rows_and_knows_nulls(spark):
    rows = spark.createDataFrame([(1, " North  Yard "), (2, "nowhere"), (3, None)], "id int, site string")
    aliases = spark.createDataFrame([("north yard", "N"), ("NORTH YARD", "M"), (None, "X")], "alias string, canonical string")
    out = conformance.with_alias(rows, "site", aliases, "code")
    assert conformance.assert_no_row_lost(rows, out) == 3 and {r.id: r.code for r in out.collect()} == {1: "M", 2: None, 3: None}
    with pytest.raises(AssertionError):
        conformance.assert_no_row_lost(rows, out.filter("code = 'M'"))
    assert {r.id: r.known for r in conformance.with_parent(out, "code", aliases, "canonical", "known").collect()} == {1: True, 2: False, 3: False}


def test_deadlines_bind(spark):
    """A supply that comes after a demand's deadline goes to the next demand; what is short stays short."""
    supply = spark.createDataFrame([("p", 1, 5, 4.0), ("p", 2, 9, 6.0)], "k string, supply_id long, at long, quantity double")
    demand = spark.createDataFrame([("p", 1, 1, 6, 7.0), ("p", 2, 2, 20, 5.0)], "k string, demand_id long, at long, deadline long, quantity double")
    assert {(r.supply_id, r.demand_id): r.allocated for r in allocation.fifo_with_deadline(supply, demand, "k").collect()} == {(1, 1): 4.0, (2, 2): 5.0}


def test_any_plan_module_can_be_imported_first():
    import subprocess
    import sys

    for name in ("reconciliation", "quality", "bindings"):
        subprocess.run([sys.executable, "-c", f"import ledgerline.plans.{name}"], check=True, timeout=60)


def test_one_to_one_refuses_repeats(spark):
    one, two = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string"), spark.createDataFrame([(1, "c"), (1, "d")], "k int, y string")
    with pytest.raises(ValueError, match="right: k 1 stands 2 times"):
        joins.one_to_one(one, two, "k")
    with pytest.raises(ValueError, match="left"):
        joins.one_to_one(two, one, "k")


def test_printed_numbers(spark):
    found = lambda t: one(spark, text.printed_numbers, t)[0].x
    assert found("Of -£1,250.50, 3m and 12% (Two or TWELVE) 4k") == ["-£1,250.50", "3m", "12%", "two", "twelve", "4k"]
    assert found("v1.2 a12 12a £x 1,23 often someone 7.") == ["1", "23", "7"]
    assert found(None) == [] == found("none")
    values = [r.x for r in one(spark, text.printed_value, "-£1,250.50", "3m", "12%", "two", "4k", "x")]
    assert values == [-1250.5, 3e6, 0.12, 2.0, 4000.0, None]


def test_date_anomalies(spark):
    contract = TableContract("a", "t", (Column("d", "date", formats=("%Y-%m-%d",)),))
    rows = spark.createDataFrame([("2024-01-02", 1), ("2024-01-03", 2), ("05/03/2024", 3), ("31/02/2024", 4), (None, 5), ("", 6)], "d string, _source_row int")
    assert {(r.anomaly, r.affected) for r in profiling.anomalies(rows, contract).collect()} == {("undeclared date format", 1), ("unreadable date", 1)}
    assert [tuple(r) for r in profiling.mixed_date_formats(rows, contract).collect()] == [("d", "%Y-%m-%d 2, %d/%m/%Y 1", 1)]
    assert [tuple(r) for r in profiling.mismatches(rows, contract).collect()] == [("d", "date", "TEXT")]
    assert tuple(profiling.table_profile(rows.limit(0), contract).first()) == (0, 1, 0, 0, 0) and profiling.mixed_date_formats(rows.limit(0), contract).count() == 0
    assert tuple(profiling.table_profile(rows, contract).first())[:4] == (6, 1, 2, 1)


def test_run_ingest(spark, tmp_path, monkeypatch):
    (tmp_path / "t.csv").write_bytes(b"id,note\n1,x\n1,x\n1,y\n2,\n3,a,b\n,z\nq,z\n")
    (tmp_path / "u.csv").write_bytes(b"# empty\nid,note\n")
    other = TableContract("a", "u", CONTRACT.columns)
    root, extracts = f"{tmp_path}/out", {f"{tmp_path}/t.csv": CONTRACT, f"{tmp_path}/u.csv": other}
    run = runs.run_ingest(spark, root, extracts)
    assert publish.current(spark, root) == run
    kept = publish.read_published(spark, root, "t").orderBy("id").collect()
    assert [(r.id, r.note, r._run_id) for r in kept] == [(1, "x", run), (2, None, run)] and publish.read_published(spark, root, "u").count() == 0
    out = publish.read_published(spark, root, "quarantine").orderBy("quarantine_id").collect()
    assert [(r.quarantine_id, r.layer, r._source_row, r.rule) for r in out] == [("Q000001", "staging", 3, "ST-02"), ("Q000002", "staging", 4, "ST-08"), ("Q000003", "raw", 6, "RAW-02"), ("Q000004", "staging", 7, "ST-03"), ("Q000005", "staging", 8, "ST-05")]
    steps = publish.read_published(spark, root, "lineage").filter("table = 't'").orderBy("step").collect()
    assert [s.rule for s in steps] == [*runs.RAW_RULES, *staging.RULES] and (steps[0].rows_in, steps[-1].rows_out) == (7, 2)
    assert all(s.rows_in == s.rows_out + s.rows_rejected for s in steps) and all(a.rows_out == b.rows_in for a, b in zip(steps, steps[1:], strict=False))
    monkeypatch.setattr(staging, "quarantine", lambda judged, real=staging.quarantine: real(judged).filter("rule <> 'ST-03'"))
    with pytest.raises(AssertionError, match="t.csv: 7 rows received, 2 staged, 4 quarantined"):
        runs.run_ingest(spark, root, extracts)
    assert publish.current(spark, root) == run
    assert sorted(r.status for r in spark.read.parquet(f"{root}/history/runs").collect()) == ["succeeded", "unbalanced"]
