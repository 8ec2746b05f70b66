"""Materials as written, resolved to one code each, and the golden record of each code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import designation, strip
from .matching import band

#: Codes of consumables, which are their own identity. Fixed pattern.
CONSUMABLE = r"^(BOLT|NUT|WASH|WIRE|PAINT|GAS)-"
#: Sections whose designation ends in their mass. Fixed values.
SERIAL = ("UB", "UC", "PFC")
WRITTEN = ("code", "description", "grade", "section_type")


def forms(frames: list[DataFrame]) -> DataFrame:
    """Distinct ways in which materials are written: code, description, grade, section_type, uoms, row_count, modal_weight.

    Frames have source_table, code, description, grade, section_type, uom and unit_weight, or lack some of them (null).
    The mode takes the smallest of equally frequent weights. Each frame is reduced by its map side before the union's shuffle.
    """
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    uoms = F.array_join(F.array_sort(F.collect_set("uom")), ",")
    return every.groupBy("source_table", *WRITTEN).agg(uoms.alias("uoms"), F.count("*").alias("row_count"), F.expr("mode(unit_weight, true)").alias("modal_weight"))


def canonical_code(kind: Column, dims: Column, grade: Column) -> Column:
    return F.concat(F.when(kind == "PLATE", "PLT").otherwise(kind), dims, F.lit("-"), grade)


def parsed(written: DataFrame) -> DataFrame:
    """``written`` with kind, dims (of the code, else of the description), the grades stated by column, code and description, and conflict."""
    one, two = F.col("_code"), F.col("_text")
    by_code = one["kind"].isNotNull()
    column = F.nullif(F.regexp_replace(F.upper(strip(F.col("grade"))), "JO", "J0"), F.lit(""))
    both = by_code & two["kind"].isNotNull() & ((one["kind"] != two["kind"]) | (one["dims"] != two["dims"]))
    read = written.withColumns({"_code": designation(F.col("code")), "_text": designation(F.col("description"))}).withColumns(
        {
            "by_code": F.coalesce(by_code, F.lit(False)), "kind": F.when(by_code, one["kind"]).otherwise(two["kind"]), "dims": F.when(by_code, one["dims"]).otherwise(two["dims"]),
            "g_column": column, "g_code": F.when(by_code, one["grade"]), "g_text": F.when(two["kind"].isNotNull(), two["grade"]), "_differ": F.coalesce(both, F.lit(False)),
        }
    )
    other = F.coalesce(F.nullif(F.col("section_type"), F.lit("")) != F.col("kind"), F.lit(False))
    stated = F.array_sort(F.array_distinct(F.array_compact(F.array("g_column", "g_code", "g_text"))))
    return read.withColumn("conflict", F.col("_differ") | other).withColumn("grades", stated).drop("_code", "_text", "_differ")


def resolve(written: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Each written form with method, score, status, resolved_grade, canonical_code (score 95 or more), proposed_code and candidates.

    catalogue: kind, dims, kg_per_m, unique by kind and dims. The first of column, code and description that states a grade
    decides; sides that disagree are held for review; with no grade stated, the grades that the designation is seen with
    anywhere are the candidates. Forms and catalogue are dimensions: they grow with spellings, not with rows.
    """
    read = parsed(written)
    stated = F.coalesce("g_column", "g_code", "g_text")
    seen = read.filter("kind is not null").filter(stated.isNotNull()).groupBy("kind", "dims").agg(F.array_sort(F.collect_set(stated)).alias("stocked"))
    listed = catalogue.groupBy("kind", "dims").agg(F.lit(True).alias("_listed"))
    known = read.join(seen, ["kind", "dims"], "left").join(listed, ["kind", "dims"], "left")
    grades, stocked = F.col("grades"), F.coalesce("stocked", F.array().cast("array<string>"))
    code = canonical_code(F.col("kind"), F.col("dims"), grades[0])
    codes = lambda of: F.nullif(F.array_join(F.transform(of, lambda g: canonical_code(F.col("kind"), F.col("dims"), g)), ", "), F.lit(""))
    missing = F.coalesce(F.col("kind") != "PLATE", F.lit(False)) & F.col("_listed").isNull()
    verdict = lambda method, score: F.struct(F.lit(method).alias("method"), F.lit(float(score)).alias("score"))
    by = F.col("by_code")
    graded = (
        F.when(by & (F.trim("code") == code), verdict("canonical_code", 100)).when(by & F.col("g_code").isNotNull(), verdict("parsed_code", 98))
        .when(by & F.col("g_column").isNotNull(), verdict("parsed_code+grade_column", 97)).when(by, verdict("parsed_code+grade_in_description", 96)).otherwise(verdict("parsed_description", 95))
    )
    capped = F.when(missing, F.struct(F.concat(graded["method"], F.lit("+not_in_catalogue")).alias("method"), F.least(graded["score"], F.lit(90.0)).alias("score"))).otherwise(graded)
    silent = F.when(F.size(stocked) == 1, verdict("grade_inferred_single_stocked_grade", 90)).when(F.size(stocked) > 1, verdict("grade_ambiguous", 85)).otherwise(verdict("designation_without_grade", 70))
    passed = ~by & F.coalesce(F.col("code").rlike(CONSUMABLE), F.lit(False))
    held = F.col("conflict") | (F.size(grades) > 1)
    ladder = F.when(passed, verdict("non_section_passthrough", 100)).when(F.col("kind").isNull(), verdict("unparsed", 0)).when(held, verdict("source_conflict", 82)).when(F.size(grades) == 1, capped).otherwise(silent)
    scored = known.withColumn("_v", ladder).withColumns({"method": F.col("_v.method"), "score": F.col("_v.score")}).withColumn("status", band(F.col("score")))
    clear = (F.size(grades) == 1) & ~held & F.col("kind").isNotNull() & ~passed
    single = F.col("method") == "grade_inferred_single_stocked_grade"
    return scored.withColumns(
        {
            "canonical_code": F.when(passed, F.col("code")).when(clear & (F.col("score") >= 95), code),
            "proposed_code": F.when(clear & (F.col("score") < 95), code).when(single, canonical_code(F.col("kind"), F.col("dims"), stocked[0])),
            "candidates": F.when(F.col("method") == "source_conflict", codes(grades)).when(single | (F.col("method") == "grade_ambiguous"), codes(stocked)),
            "resolved_grade": F.when(clear, grades[0]).when(single, stocked[0]),
        }
    ).select(*written.columns, "kind", "dims", "method", "score", "status", "resolved_grade", "canonical_code", "proposed_code", "candidates")


def golden(resolved: DataFrame, catalogue: DataFrame, tolerance: float = 0.02, bar_m: float = 12.0) -> DataFrame:
    """One record for each code of accepted forms: mass and where it comes from, units seen, and rows that wait for review.

    Mass: a plate's 7.85 kg a mm, else the catalogue's, else the last dimension of SERIAL sections, else the most frequent
    unit weight of the forms (the smallest of ties).
    """
    auto = resolved.filter("status = 'auto' and method <> 'non_section_passthrough'")
    one = auto.groupBy("canonical_code").agg(
        F.min("kind").alias("kind"), F.min("dims").alias("dims"), F.min("resolved_grade").alias("grade"), F.expr("mode(modal_weight, true)").alias("modal"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter(F.split("uoms", ","), lambda u: u != ""))))).alias("_uoms"), F.count("*").alias("forms"), F.sum("row_count").alias("source_rows"),
    )
    waiting = resolved.filter("status = 'review'").select(F.explode(F.split(F.coalesce("candidates", "proposed_code"), ", ")).alias("canonical_code"), "row_count").groupBy("canonical_code").agg(F.sum("row_count").alias("_waiting"))
    listed = catalogue.groupBy("kind", "dims").agg(F.min("kg_per_m").alias("_mass"))
    both = one.join(listed, ["kind", "dims"], "left").join(waiting, "canonical_code", "left")
    plate, serial = F.col("kind") == "PLATE", F.col("kind").isin(*SERIAL)
    last = F.element_at(F.split("dims", "X"), -1).try_cast("double")
    mass = F.when(plate, F.round(F.col("dims").try_cast("double") * 7.85, 2)).when(F.col("_mass").isNotNull(), F.col("_mass").cast("double")).when(serial, last).otherwise(F.col("modal").cast("double"))
    source = F.when(plate, "plate: 7.85 kg/m2 per mm").when(F.col("_mass").isNotNull(), "section catalogue").when(serial, "serial mass in designation").otherwise("modal BOM unit weight")
    return both.withColumn("mass", mass).select(
        "canonical_code", "kind", "dims", "grade", "mass", source.alias("mass_source"), F.col("modal").cast("double").alias("modal_weight"),
        F.coalesce(F.abs(F.col("modal") - F.col("mass")) > F.col("mass") * tolerance, F.lit(False)).alias("mass_deviation"), F.when(plate, "KG").otherwise("M").alias("base_uom"),
        F.when(~plate, F.round(F.col("mass") * bar_m, 2)).alias("kg_per_ea"), F.array_join("_uoms", ", ").alias("observed_uoms"), (F.size("_uoms") > 1).alias("uom_conflict"), "forms", "source_rows", F.coalesce("_waiting", F.lit(0)).alias("pending_review_rows"),
    )

