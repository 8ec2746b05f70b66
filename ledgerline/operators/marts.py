"""KPI marts: views with their descriptions, and a scorecard over them. Definitions are rows, judged by queries."""

from __future__ import annotations

from dataclasses import astuple, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Who may answer for a KPI, how its value is judged, and how much a caveat must say. Fixed values.
OWNERS = ("Production Controller", "Finance Manager", "Quality Manager", "Managing Director")
DIRECTIONS = ("higher", "lower", "abs_lower", "band", "none")
CAVEAT_WORDS = 20
DEFINITION = "id string, name string, owner string, caveat string, direction string, view string, aggregate string, target double, low double, high double"


@dataclass(frozen=True)
class Kpi:
    """One figure: ``aggregate``, an SQL expression, over the rows of ``view``; ``views`` maps the views it needs to their descriptions."""

    id: str
    name: str
    owner: str
    caveat: str
    direction: str
    view: str
    aggregate: str
    target: float | None = None
    low: float | None = None
    high: float | None = None
    views: dict[str, str] = field(default_factory=dict)


def definitions(spark: SparkSession, kpis: list[Kpi]) -> DataFrame:
    return spark.createDataFrame([astuple(k)[:10] for k in kpis], DEFINITION)


def problems(defined: DataFrame, owners: tuple[str, ...] = OWNERS) -> DataFrame:
    """id and problem: everything that is wrong with the definitions, a row for each."""
    said = lambda test, text: F.when(F.coalesce(test, F.lit(True)), F.lit(text))
    direction, aims = F.col("direction"), F.col("direction").isin("higher", "lower", "abs_lower")
    wrong = F.array_compact(F.array(
        *(said(F.trim(c) == "", f"no {c}") for c in ("id", "name", "owner", "caveat", "view", "aggregate")),
        said(F.col("_same") > 1, "id is used twice"), said(F.size(F.split(F.trim("caveat"), r"\s+")) < CAVEAT_WORDS, f"a caveat has {CAVEAT_WORDS} words"),
        said(~F.col("owner").isin(*owners), "owner isn't known"), said(~direction.isin(*DIRECTIONS), "direction isn't known"),
        said(aims & F.col("target").isNull(), "no target"), said((direction == "band") & (F.col("low").isNull() | F.col("high").isNull()), "no band"),
    ))
    return defined.withColumn("_same", F.count("*").over(Window.partitionBy("id"))).select("id", F.explode(wrong).alias("problem"))


def validate(spark: SparkSession, kpis: list[Kpi], owners: tuple[str, ...] = OWNERS) -> None:
    """Raises with all problems at once."""
    wrong = [f"{r.id}: {r.problem}" for r in problems(definitions(spark, kpis), owners).orderBy("id", "problem").collect()] if kpis else ["no KPI is defined"]
    if wrong:
        raise ValueError("; ".join(wrong))


def status() -> Column:
    """on target, off target, for information or no data, of the columns value, direction, target, low and high."""
    value, direction = F.col("value"), F.col("direction")
    near = F.when(direction == "lower", value <= F.col("target")).when(direction == "higher", value >= F.col("target")).when(direction == "abs_lower", F.abs(value) <= F.col("target")).otherwise(value.between(F.col("low"), F.col("high")))
    return F.when(value.isNull() | F.isnan(value), "no data").when(direction == "none", "for information").when(near, "on target").otherwise("off target")


def values(spark: SparkSession, kpis: list[Kpi]) -> DataFrame:
    """id and value of every KPI: all figures of a view come from one aggregation of it."""

    def of(view: str) -> DataFrame:
        own = [k for k in kpis if k.view == view]
        once = spark.table(view).agg(*(F.expr(k.aggregate).cast("double").alias(f"_{i}") for i, k in enumerate(own)))
        return once.select(F.explode(F.array(*(F.struct(F.lit(k.id).alias("id"), F.col(f"_{i}").alias("value")) for i, k in enumerate(own)))).alias("v")).select("v.*")

    return reduce(DataFrame.unionByName, [of(v) for v in dict.fromkeys(k.view for k in kpis)])


def scorecard(spark: SparkSession, kpis: list[Kpi]) -> DataFrame:
    """kpi, name, owner, value, target and status, a row for each KPI."""
    joined = definitions(spark, kpis).join(values(spark, kpis), "id")
    return joined.select(F.col("id").alias("kpi"), "name", "owner", "value", "target", status().alias("status"))


def described(views: dict[str, str], kpis: list[Kpi], helpers: dict[str, str] | None = None) -> dict[str, str]:
    """Each view with its description; a view that nobody describes, or a description of none, is an error."""
    told = dict(helpers or {}) | {v: t for k in kpis for v, t in k.views.items()}
    if set(told) != set(views):
        raise ValueError(f"built but not described: {sorted(set(views) - set(told))}; described but not built: {sorted(set(told) - set(views))}")
    return {name: told[name] for name in views}


def build(spark: SparkSession, views: dict[str, str], kpis: list[Kpi], helpers: dict[str, str] | None = None) -> DataFrame:
    """Creates the views (name to SQL, in order) as temporary views and gives the scorecard."""
    described(views, kpis, helpers)
    validate(spark, kpis)
    for name, sql in views.items():
        spark.sql(sql).createOrReplaceTempView(name)
    return scorecard(spark, kpis)


def share(test: Column) -> Column:
    return F.avg(test.cast("int"))
