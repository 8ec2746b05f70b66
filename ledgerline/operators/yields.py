"""Material yield: bars cut into pieces, what that leaves over, and how it compares with what was issued and received."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .job_cost import kilograms

#: Flat material isn't cut from bars. Fixed value.
PLATE = "PLATE"
#: Sums are exact in this type, so they don't depend on the plan.
GRAMS = "decimal(28,3)"


def cut_lines(lines: DataFrame) -> DataFrame:
    """The ``lines`` that are cut from bars, with pieces, pieces_per_bar, bars, used_m, bought_m, offcut_m, used_kg and bought_kg.

    lines: section_type, uom, qty, length_mm, kg, bar_length_mm. Lines in metres of pieces that a bar can hold are cut; plates,
    other units and longer pieces aren't. A line of less than half a piece has no pieces and no bars, and its bought_kg is null.
    """
    length, bar = F.col("length_mm"), F.col("bar_length_mm")
    fits = (F.col("uom") == "M") & (F.col("section_type") != PLATE) & length.between(1, bar)
    cut = lines.filter(fits).withColumn("pieces", F.round(F.col("qty") * 1000 / length).cast("long")).withColumn("pieces_per_bar", F.floor(bar / length))
    cut = cut.withColumn("bars", F.ceil(F.col("pieces") / F.col("pieces_per_bar")))
    used, bought = F.col("pieces") * length, F.col("bars") * bar
    return cut.withColumns({"used_m": used / 1000.0, "bought_m": bought / 1000.0, "offcut_m": bought / 1000.0 - used / 1000.0, "used_kg": F.col("kg").cast("double"), "bought_kg": F.try_divide(F.col("kg") * bought.cast("double"), used.cast("double"))})


def received_weight(receipts: DataFrame, xref: DataFrame, golden: DataFrame) -> DataFrame:
    """``receipts`` (material_code, qty, uom) with section_type and kg, by the code they are taken for.

    That is the confirmed code, else the proposed one, else the first candidate. xref: source_code, canonical_code,
    proposed_code, candidates (comma-joined), unique by source_code; golden: canonical_code, section_type, mass (a metre),
    kg_per_ea, unique by canonical_code. A receipt whose code nobody knows has neither, and one in another unit no kg.
    """
    taken = xref.select(F.col("source_code").alias("material_code"), F.coalesce("canonical_code", "proposed_code", F.split("candidates", ", ")[0]).alias("canonical_code"))
    known = receipts.join(taken, "material_code", "left").join(golden.select("canonical_code", "section_type", "mass", "kg_per_ea"), "canonical_code", "left")
    return known.withColumn("kg", kilograms(F.col("qty"), F.col("uom"), F.col("mass"), F.col("kg_per_ea"))).drop("mass", "kg_per_ea")


def by_section(lines: DataFrame, received: DataFrame) -> DataFrame:
    """The yield of each section type that was issued: cut and bought weight of its cut lines, all that was issued and received.

    lines as in cut_lines(); received: section_type, kg. Each side is summed before they meet, so none multiplies another; a
    type that was never cut from bars, or never received, has nulls there.
    """
    total = lambda c: F.sum(F.col(c).cast(GRAMS)).cast("double")
    cut = cut_lines(lines).groupBy("section_type").agg(F.count("*").alias("bom_lines"), total("used_kg").alias("used"), total("bought_kg").alias("bought"))
    issued = lines.groupBy("section_type").agg(total("kg").alias("issued"))
    arrived = received.groupBy("section_type").agg(total("kg").alias("arrived"))
    met = issued.join(cut, "section_type", "left").join(arrived, "section_type", "left")
    share = F.try_divide(100 * F.col("used"), F.col("bought"))
    return met.select(
        "section_type", "bom_lines", F.round("used").alias("cut_used_kg"), F.round("bought").alias("cut_bought_kg"), F.round(share, 1).alias("cut_yield_pct"), F.round(100 - share, 1).alias("offcut_waste_pct"),
        F.round("issued").alias("issued_kg"), F.round("arrived").alias("received_kg"), F.round(F.try_divide("arrived", "issued"), 2).alias("received_to_issued"),
    )
