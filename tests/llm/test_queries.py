"""What the registered corpus queries compute."""

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import mixture, quality_classifier, queries
from ledgerline.llm.common import only_rows, table

SF = "/root/testdata/sf0.01"


def plan_of(docs, shards):
    return {r.doc_id: r for r in mixture.mix_plan(docs, shards=shards).collect()}


def test_op8_takes_what_the_tree_deals_to_the_shards(spark, monkeypatch):
    """The quotas decide the words: other shards, or other draws of the tree, take other documents, and the same words of each source."""
    docs = table(spark, SF, "documents")
    few, many = plan_of(docs, 2), plan_of(docs, 64)
    monkeypatch.setattr(mixture, "hypergeometric", lambda u, population, marked, draws: F.greatest(F.lit(0).cast("long"), draws - (population - marked)))
    least = plan_of(docs, 64)
    for a, b in ((few, many), (many, least)):
        assert any(a[i].taken != b[i].taken for i in a) and any(a[i].shard != b[i].shard for i in a)
        words = [defaultdict(int), defaultdict(int)]
        for k, plan in enumerate((a, b)):
            for r in plan.values():
                words[k][r.source] += r.taken
                assert r.taken == sum(d.words for d in r.draws) <= 2 * r.size and {d.shard for d in r.draws} <= {r.shard}
        assert words[0] == words[1] == {r.source: int(r.target + 1e-9) for r in a.values()}


def test_op8_shards_hold_their_quotas_and_their_part_of_each_target(spark):
    docs = table(spark, SF, "documents")
    found = {r.doc_id: (r.shard, r.taken) for r in queries.op8_mixture(spark, SF).collect()}
    plan = plan_of(docs, None)
    assert found == {i: (r.shard, r.taken) for i, r in plan.items()}
    held, size, target = defaultdict(Counter), defaultdict(Counter), {}
    for r in plan.values():
        held[r.shard][r.source] += r.taken
        size[r.shard][r.source] += r.size
        target[r.source] = int(r.target + 1e-9), r.source_size
    assert len(held) == 16
    for shard, own in held.items():
        for source, words in own.items():
            want, whole = target[source]
            assert abs(words - size[shard][source] * want / whole) <= 2


def test_rows_with_maps_are_told_apart(spark):
    docs = spark.createDataFrame([(1, "a", {"x": 1}, [1]), (1, "a", {"x": 2}, [2]), (2, "b", None, None)], "doc_id long, text string, m map<string,int>, a array<int>").withColumn("v", F.parse_json(F.lit('{"k": 1}')))
    kept = docs.select("doc_id", F.xxhash64("text").alias("h"))
    rows = only_rows(docs, kept, F.xxhash64("text"))
    assert rows.columns == docs.columns and sorted(r.doc_id for r in rows.collect()) == [1, 2]


def test_a_rated_document_repeated_many_times_is_one_row_of_the_sample(spark, monkeypatch):
    texts = [(k, f"word{k % 5} other{k % 3} {'good' * (k % 2)}") for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k, _ in texts], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = []
    fit = quality_classifier.fit_ordinal
    monkeypatch.setattr(quality_classifier, "fit_ordinal", lambda grade, bags, *rest: rows.append(len(bags)) or fit(grade, bags, *rest))
    plain = quality_classifier.train(docs, labels)
    copies = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(texts[7][1]).alias("text"))
    again = quality_classifier.train(docs.unionByName(copies), labels)
    assert rows == [60, 60] and np.array_equal(plain.weights, again.weights) and np.array_equal(plain.thetas, again.thetas)
