"""Reports over published tables: named figures in templates, and Markdown tables that are written and read back."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def pounds(value: float, digits: int = 2) -> str:
    return f"{'-' if value < 0 else ''}£{abs(value):,.{digits}f}"


def percent(value: float, digits: int = 1) -> str:
    """Of a share of 1."""
    return f"{100 * value:.{digits}f}%"


def count(value: float) -> str:
    return f"{value:,.0f}"


def figures(spark: SparkSession, named: dict[str, tuple[str, Callable[[object], str]]]) -> dict[str, str]:
    """Each figure of (SQL, formatter) as text. The SQL gives one row of one column; any other result is an error."""
    out = {}
    for name, (sql, shown) in named.items():
        rows = spark.sql(sql).limit(2).collect()
        if len(rows) != 1 or len(rows[0]) != 1:
            raise ValueError(f"{name}: not one figure")
        out[name] = shown(rows[0][0])
    return out


def fill(template: str, values: dict[str, str]) -> str:
    """``template`` with each {{name}} replaced; names without a value, and values that the template never uses, are errors."""
    asked = set(re.findall(r"\{\{\s*(\w+)\s*\}\}", template))
    if asked != set(values):
        raise ValueError(f"no value: {sorted(asked - set(values))}; not used: {sorted(set(values) - asked)}")
    return re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m: values[m[1]], template)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A Markdown table of a small result in the order it has; more than ``most`` rows are an error, not cut off."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *([cell(v) for v in r] for r in rows)]
    return "".join(f"| {' | '.join(line)} |\n" for line in lines)


def markdown_rows(text: str, header: str) -> list[list[str]]:
    """The cells of the first table whose header line begins with ``header``; none if there is no such table."""
    lines = [line.strip() for line in text.splitlines()]
    start = next((i for i, line in enumerate(lines) if line.startswith(header)), None)
    out: list[list[str]] = []
    for line in lines[start + 2 :] if start is not None else []:
        if not line.startswith("|"):
            break
        out.append([c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)[1:-1]])
    return out
