"""Number provenance: figures written in texts, each vouched for by at most one entry of a ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import numbers
from .numbering import numbered
from .scan import scanned

#: What is written in figures but counts nothing: kind and pattern, masked in this order before a text is scanned. Fixed patterns.
MASKS = (
    ("date", r"\b\d{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) \d{4}\b"), ("date", r"\b\d{4}-\d{2}-\d{2}\b"), ("date", r"\b\d{2}/\d{2}/\d{4}\b"),
    ("job", r"\bJ-\d{2}-\d{4}\b"), ("rule", r"\b(?:DQ|KPI|ST|CO|MA|RC|RAW)-\d{2}[a-z]?\b"), ("risk", r"\bR\d{2}\b"), ("assumption", r"\bA\d\b"), ("standard", r"\bEN(?: ISO)? \d{4,5}(?:-\d)?\b"),
    ("certificate", r"\b3\.1 (?:mill )?(?:certificates?|inspection documents?|documents?)\b"), ("clause", r"\bclause \d+(?:\.\d+)*"), ("page", r"\b(?:Page|on page) \d+"),
    ("month", r"\bM\d{1,2}\b"), ("phase", r"\b[Pp]hases? \d+(?:(?:, | and | to )\d+)*\b"), ("scale", r"(?:\b0 to|out of|/) 100\b"), ("scale", r"\bscored from 1 to 5\b"), ("window", r"\blast 12 months\b"),
)


def number_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, place and token of each figure in a text, in order; null texts have none."""
    return df.select(F.col(key), F.posexplode(numbers(F.coalesce(F.col(text), F.lit("")))).alias("place", "token"))


def masked(text: Column) -> Column:
    """``text`` without the identifiers of MASKS."""
    return reduce(lambda out, mask: F.regexp_replace(out, mask[1], " "), MASKS, text)


def structure(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind and n: how many identifiers of each kind of MASKS a text holds, by the order of masking."""
    # Each match becomes a mark of its pattern, so one pass over the text counts all.
    marks = [chr(0xE000 + i) for i in range(len(MASKS))]
    bare = F.translate(F.coalesce(F.col(text), F.lit("")), "".join(marks), "")
    for (_, pattern), mark in zip(MASKS, marks, strict=True):
        bare = F.regexp_replace(bare, pattern, mark)
    held = lambda mark: F.length("_text") - F.length(F.replace("_text", F.lit(mark)))
    kinds = {kind: sum((held(m) for (k, _), m in zip(MASKS, marks, strict=True) if k == kind), F.lit(0)) for kind, _ in MASKS}
    counts = F.array(*(F.struct(F.lit(kind).alias("kind"), n.cast("long").alias("n")) for kind, n in kinds.items()))
    return df.select(F.col(key), bare.alias("_text")).select(key, F.explode(counts).alias("c")).select(key, "c.kind", "c.n").filter("n > 0")


def figure_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """number_tokens() of the texts as masked(): the figures that must be vouched for."""
    return number_tokens(df.select(F.col(key), masked(F.coalesce(F.col(text), F.lit(""))).alias("_text")), key, "_text")


def attributed(tokens: DataFrame, ledger: DataFrame, scope: str) -> DataFrame:
    """scope, place, token and origin (null if none) of tokens (scope, place, token), by the ledger (scope, place, text, origin).

    A figure is vouched for within its own scope alone, such as a page of a report, and each entry vouches once. Figures and
    entries are paired by what they say and by what follows them, the first with the first; then those that are left by what
    they say, again in order. So as many figures of a text have an origin as there are entries for it, and a figure printed
    between the same neighbours as its entry was keeps it although other figures were added or left out. Scans over ranges of
    (scope, place) number both sides, so a scope or a figure of any size spreads over tasks. Places tell the rows of a scope
    apart; rows that share one are paired in any order. A null scope is a scope.
    """
    said = scanned(tokens.select(scope, F.col("place").cast("int").alias("place"), "token"), [scope], ["place"], _after=("next", "token"))
    held = ledger.select(F.col(scope).alias("_scope"), F.col("place").alias("_at"), F.col("text").alias("_text"), "origin", F.lit(True).alias("_met"))
    held = scanned(held, ["_scope"], ["_at"], _next=("next", "_text"))
    same = F.col(scope).eqNullSafe(F.col("_scope")) & (F.col("token") == F.col("_text"))
    said, held = numbered(said, ["place"], "_nth", [scope, "token", "_after"]), numbered(held, ["_at"], "_mth", ["_scope", "_text", "_next"])
    beside = same & F.col("_after").eqNullSafe(F.col("_next")) & (F.col("_nth") == F.col("_mth"))
    found, spare = said.join(held, beside, "left"), held.join(said, beside, "left_anti")
    rest = numbered(found.filter("_met is null").select(scope, "place", "token"), ["place"], "_nth", [scope, "token"])
    spare = numbered(spare.drop("_mth"), ["_at"], "_mth", ["_scope", "_text"])
    out = [scope, "place", "token", "origin"]
    return found.filter("_met").select(*out).unionByName(rest.join(spare, same & (F.col("_nth") == F.col("_mth")), "left").select(*out))
