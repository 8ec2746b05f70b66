"""Profiles of text tables: blanks, distinct values, inferred types and anomalies, in one aggregate per table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import DATE_FORMATS, coerce_number, parse_date, strip
from ..sources.contracts import TableContract

#: Inferred types that fit a declared one. Fixed values.
COMPATIBLE = {"text": ("TEXT", "INTEGER", "DECIMAL", "DATE"), "integer": ("INTEGER",), "decimal": ("INTEGER", "DECIMAL"), "date": ("DATE",)}


def profile_columns(df: DataFrame, columns: list[str], formats: list[str] | None = None) -> DataFrame:
    """One row per column: rows, blanks, distinct_values (unstripped), padded, inferred_type.

    The type is INTEGER if all filled cells are whole numbers, else DECIMAL, else DATE, else TEXT; without filled cells it
    is TEXT. Null counts as blank.
    """
    formats = formats or ["%Y-%m-%d"]
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("v")) for i, c in enumerate(columns, 1))))
    cells = df.select(pairs.alias("p")).select("p.*").groupBy("ordinal", "column_name", "v").agg(F.count("*").alias("n"))  # distinct values meet before anything is parsed
    bare = strip(F.col("v"))
    filled = bare != ""
    every = lambda test: F.bool_and(F.when(filled, test))
    return cells.groupBy("ordinal", "column_name").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(~filled, F.col("n"))), F.lit(0)).alias("blanks"), F.count("*").alias("distinct_values"),
        F.coalesce(F.sum(F.when(bare != F.col("v"), F.col("n"))), F.lit(0)).alias("padded"),
        F.when(every(bare.rlike(r"^[+-]?\d+$")), "INTEGER").when(every(bare.rlike(r"^[+-]?\d+(\.\d+)?$")), "DECIMAL").when(every(parse_date(bare, formats).isNotNull()), "DATE").otherwise("TEXT").alias("inferred_type"),
    )


def mismatches(df: DataFrame, contract: TableContract) -> DataFrame:
    """column_name, declared, inferred of the columns whose cells are of a type that doesn't fit the declared one."""
    profile = profile_columns(df, contract.names, list(DATE_FORMATS))
    declared = F.create_map(*(F.lit(x) for c in contract.columns for x in (c.name, c.type)))
    fits = F.create_map(*(x for kind, types in COMPATIBLE.items() for x in (F.lit(kind), F.array(*(F.lit(t) for t in types)))))
    named = profile.select("column_name", F.try_element_at(declared, F.col("column_name")).alias("declared"), F.col("inferred_type").alias("inferred"))
    return named.filter(~F.array_contains(F.try_element_at(fits, F.col("declared")), F.col("inferred")))


def table_profile(df: DataFrame, contract: TableContract) -> DataFrame:
    """One row: n_rows, n_columns, blank_cells, exact_duplicates and duplicate_keys, the latter among rows that are no exact duplicates.

    Null cells count as blank. Equal rows meet before their keys do, so a hot row or key is counted where it is read.
    """
    cells = df.select(*(F.coalesce(F.col(n), F.lit("")).alias(n) for n in contract.names))
    rows = cells.groupBy(*contract.names).agg(F.count("*").alias("_n"))
    blanks = sum(((strip(F.col(n)) == "").cast("int") for n in contract.names), F.lit(0))
    keys = rows.groupBy(*(contract.key or contract.names)).agg(F.sum("_n").alias("n"), F.count("*").alias("texts"), F.sum(F.col("_n") * blanks).alias("blanks"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return keys.agg(total("n").alias("n_rows"), F.lit(len(contract.names)).alias("n_columns"), total("blanks").alias("blank_cells"), (total("n") - total("texts")).alias("exact_duplicates"), (total("texts") - F.count("*")).alias("duplicate_keys"))


def mixed_date_formats(df: DataFrame, contract: TableContract) -> DataFrame:
    """column_name, formats (as ``%Y-%m-%d 12``, by format) and affected, the cells outside the commonest format, of date columns that use several."""
    dates = [c.name for c in contract.columns if c.type == "date"]
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("column_name"), strip(F.col(n)).alias("v")) for n in dates)) if dates else F.expr("CAST(array() AS array<struct<column_name:string,v:string>>)")).alias("c")).select("c.*")
    values = cells.groupBy("column_name", "v").agg(F.count("*").alias("n"))  # a text is parsed once, however often it stands
    counts = values.groupBy("column_name").agg(*(F.coalesce(F.sum(F.when(parse_date(F.col("v"), [f]).isNotNull(), F.col("n"))), F.lit(0)).alias(f) for f in DATE_FORMATS))
    used = F.filter(F.array(*(F.struct(F.lit(f).alias("format"), F.col(f"`{f}`").alias("n")) for f in sorted(DATE_FORMATS))), lambda x: x["n"] > 0)
    found = counts.select("column_name", used.alias("used")).filter("size(used) > 1")
    written = F.array_join(F.transform("used", lambda x: F.concat(x["format"], F.lit(" "), x["n"].cast("string"))), ", ")
    affected = F.aggregate("used", F.lit(0).cast("long"), lambda s, x: s + x["n"]) - F.array_max(F.transform("used", lambda x: x["n"]))
    return found.select("column_name", written.alias("formats"), affected.alias("affected"))


def anomalies(df: DataFrame, contract: TableContract) -> DataFrame:
    """column_name, anomaly, affected and up to five distinct samples in file order, for anomalies that occur."""
    out = []
    for c in contract.columns:
        raw = F.coalesce(F.col(c.name), F.lit(""))
        bare = strip(raw)
        filled = bare != ""
        tests = {"padding": raw != bare}
        if c.required:
            tests["blank in required"] = ~filled
        if c.type == "date":
            known, declared = parse_date(bare, list(DATE_FORMATS)), parse_date(bare, list(c.formats))
            tests["undeclared date format"] = filled & known.isNotNull() & declared.isNull()
            tests["unreadable date"] = filled & known.isNull()
        if c.type in ("decimal", "integer"):
            tests["number as text"] = filled & coerce_number(bare).isNotNull() & (coerce_number(bare) != bare)
            tests["not a number"] = filled & coerce_number(bare).isNull()
        if c.type == "integer":
            tests["not whole"] = F.coalesce(coerce_number(bare).contains("."), F.lit(False))
        if c.domain:
            tests["outside domain"] = filled & ~bare.isin(*c.domain)
        if c.pattern:
            tests["off pattern"] = filled & ~bare.rlike(f"^(?:{c.pattern})$")
        out += [F.struct(F.lit(c.name).alias("column_name"), F.lit(a).alias("anomaly"), t.alias("hit"), raw.alias("v")) for a, t in tests.items()]
    hits = df.select("_source_row", F.explode(F.array(*out)).alias("x")).filter("x.hit").groupBy("x.column_name", "x.anomaly", "x.v").agg(F.count("*").alias("n"), F.min("_source_row").alias("at"))

    placed = hits.withColumn("place", F.row_number().over(Window.partitionBy("column_name", "anomaly").orderBy("at", "v")))
    return placed.groupBy("column_name", "anomaly").agg(F.sum("n").alias("affected"), F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= 5, F.struct("at", "v")))), lambda s: s["v"]).alias("samples"))


def case_variants(df: DataFrame, column: str) -> DataFrame:
    """Values that differ only in case and spacing: folded, spellings (sorted), affected rows."""
    folded = F.lower(F.regexp_replace(strip(F.col(column)), r"\s+", " "))
    by_value = df.filter(F.col(column).isNotNull()).groupBy(folded.alias("folded"), F.col(column).alias("v")).agg(F.count("*").alias("n"))
    return by_value.groupBy("folded").agg(F.array_join(F.array_sort(F.collect_set("v")), "|").alias("spellings"), F.count("*").alias("n_spellings"), F.sum("n").alias("affected")).filter("n_spellings > 1")
