"""Configuration and small reference tables, read on the driver."""

from __future__ import annotations

import csv
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def load_toml(path: str) -> dict:
    return tomllib.loads(Path(path).read_text(encoding="utf-8"))


def load_yaml(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """kind, designation, kg_per_m; lines that begin with # are comments."""
    lines = [x for x in Path(path).read_text(encoding="utf-8").splitlines() if not x.startswith("#")]
    return spark.createDataFrame([(r["kind"], r["designation"].upper(), float(r["kg_per_m"])) for r in csv.DictReader(lines)], "kind string, designation string, kg_per_m double")


def aliases(spark: SparkSession, named: dict[str, list[str]]) -> DataFrame:
    """alias (lower case) and code, each alias once."""
    pairs = sorted({(a.casefold(), code) for code, names in named.items() for a in [code, *names]})
    clash = {a for a, _ in pairs if sum(a == b for b, _ in pairs) > 1}
    if clash:
        raise ValueError(f"aliases with two codes: {sorted(clash)}")
    return spark.createDataFrame(pairs, "alias string, code string")
