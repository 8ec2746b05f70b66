"""License scans by diagonal voting, in DataFrame functions alone.

All rolling word 2-gram hashes of every text are joined to their positions in the templates, a fixed list. A hit votes for
the diagonal text position - template position, which is where the template would begin; votes are kept as one bit for
each template position, in masks of 63, so a template may be a whole license text. Neighbouring diagonals merge, which
bridges inserted and missing words, and a span is verified by the share of the template that it holds, in a stretch not
much longer than the template. Phrases need all their positions on one diagonal, so they are found exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower

# Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Notices and their labels.
NOTICES = (
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl-notice"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-text"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
COVERAGE, STRETCH, BAND = 0.75, 1.3, 2
#: Positions of a template that one mask holds, and words of all templates together: their positions are broadcast.
BITS, MOST_WORDS = 63, 1 << 20
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands for the document itself among the grams, so a text without hits still gives a row.
SELF = 0


def _gram(a: Column, b: Column) -> Column:
    return F.struct(F.xxhash64(a, b).alias("h"), a.alias("a"), b.alias("b"))


def _grams(words: Column) -> Column:
    """All 2-grams, each with its own two words alone, so that a row of it stays narrow however long the text is."""
    n = F.size(words)
    return F.when(n >= 2, F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), _gram)).otherwise(F.array().cast("array<struct<h:bigint,a:string,b:string>>"))


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row for each template, by the fixed list: template, label, phrase, words, grams. Template 0 is the document itself."""
    rows = [(0, "", "", False)] + [(k, text, label, k <= len(phrases)) for k, (text, label) in enumerate([*phrases, *notices], 1)]
    lengths = [len(text.split()) for _, text, _, _ in rows[1:]]
    if min(lengths, default=2) < 2 or sum(lengths) > MOST_WORDS:
        raise ValueError(f"a template has 2 words or more, and all have {MOST_WORDS} at most")
    fields = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("template", "text", "label", "phrase"), row, strict=True))) for row in rows))
    each = spark.range(1).select(F.inline(fields)).withColumn("words", F.split("text", " "))
    return each.select("template", "label", "phrase", "words", (F.size("words") - 1).alias("grams"))


def _positions(listed: DataFrame) -> DataFrame:
    """One row for each 2-gram of each template: h, template, tpos, a, b, part, bit; and one for template 0."""
    grams = listed.filter("template > 0").select("template", F.posexplode(_grams(F.col("words"))).alias("tpos", "gram"))
    itself = listed.filter("template = 0").select(F.lit(SELF).cast("long").alias("h"), "template", F.lit(-1).alias("tpos"), F.lit("").alias("a"), F.lit("").alias("b"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("bit"))
    return grams.select("gram.h", "template", "tpos", "gram.a", "gram.b", F.floor(F.col("tpos") / BITS).cast("int").alias("part"), F.expr(f"shiftleft(1L, tpos % {BITS})").alias("bit")).unionByName(itself)


def license_scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of phrases; first_word and last_word are their smallest and largest starts, from 0, or null.
    labels has the phrases' labels and those of verified notices, distinct, sorted and comma-joined; score is the largest
    share of a template that was found, 1 for a phrase, 0 for nothing. Null and empty texts have no words and no labels.
    Repeated rows are judged once and give repeated results; an empty table gives an empty result; other columns are
    ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"), F.regexp_extract_all(ascii_lower(text), F.lit(WORDS), F.lit(0)).alias("words"))
    itself = F.array(F.struct(F.lit(SELF).cast("long").alias("h"), F.lit("").alias("a"), F.lit("").alias("b")))
    # The words' number is a column of its own before the grams are dealt out, or each row would carry all words beside it. The
    # grams are dealt out of an expression: of a column, Spark would infer a filter that splits the text again.
    counted = tokens.select("doc_id", "tid", F.size("words").alias("n_words"), "words")
    grams = counted.select("doc_id", "tid", "n_words", F.posexplode(F.concat(itself, _grams(F.col("words")))).alias("pos", "gram"))
    grams = grams.select("doc_id", "tid", "n_words", "pos", "gram.h", F.col("gram.a").alias("one"), F.col("gram.b").alias("two"))
    listed = templates(docs.sparkSession, phrases, notices)
    at = F.col("pos") - 1
    verified = ((F.col("template") == 0) & (F.col("pos") == 0)) | ((F.col("template") > 0) & (F.col("pos") > 0) & (F.col("one") == F.col("a")) & (F.col("two") == F.col("b")))
    # Both broadcasts are of the fixed list above. Hits are narrow, so votes are counted before they are shuffled.
    hits = grams.join(F.broadcast(_positions(listed)), "h").filter(verified).select(
        "doc_id", "tid", "template", F.when(F.col("template") > 0, at - F.col("tpos")).alias("diagonal"), at.alias("at"), "part", "bit",
        F.when(F.col("template") == 0, F.col("n_words")).alias("n_words"),
    )
    by = ["doc_id", "tid", "template"]
    votes = hits.groupBy(*by, "diagonal", "part").agg(F.bit_or("bit").alias("mask"), F.max("n_words").alias("n_words"), F.min("at").alias("low"), F.max("at").alias("high"), F.count("n_words").alias("copies"))
    votes = votes.join(F.broadcast(listed.select("template", "label", "phrase", "grams")), "template")
    run = Window.partitionBy(*by).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(run) > F.when(F.col("phrase"), 0).otherwise(BAND), F.lit(False))
    spans = [*by, "label", "phrase", "grams", "span"]
    rest = [F.max("n_words").alias("n_words"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("copies").alias("copies")]
    parts = votes.withColumn("span", F.sum(apart.cast("int")).over(run)).groupBy(*spans, "part").agg(F.bit_count(F.bit_or("mask")).alias("found"), *rest)
    merged = parts.groupBy(*spans).agg(F.sum("found").alias("found"), *rest)
    share = F.col("found") / F.greatest("grams", F.lit(1))
    tight = F.col("high") - F.col("low") + 1 <= F.ceil(F.col("grams") * STRETCH)
    base = F.col("phrase") & (F.col("found") == F.col("grams"))
    notice = ~F.col("phrase") & (F.col("template") > 0) & (share >= COVERAGE) & tight
    joined = lambda test: F.array_join(F.array_sort(F.collect_set(F.when(test, F.col("label")))), ",")
    return merged.groupBy("doc_id", "tid").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("low"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("low"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(base | notice).alias("labels"),
        F.coalesce(F.max(F.when(base | notice, share)), F.lit(0.0)).alias("score"), F.max("copies").cast("int").alias("copies"),
    ).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("tid", "copies", "copy")
