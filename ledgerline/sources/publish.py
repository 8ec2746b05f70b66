"""Publication: tables are built in a run's own folder, and a manifest names the run of each table that is published.

A publication writes the next manifest, once what it has built has been verified, by one rename that doesn't replace: of two
that began from one manifest the second fails, so neither loses what the other published. Readers take the last manifest.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import in_slices, remove, written

MANIFESTS = "manifests"


class PublishedMeanwhile(RuntimeError):
    """Another publication has come between this one's beginning and its end."""


def _fs(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark.sparkContext._jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of all manifests, ascending."""
    fs, path = _fs(spark, root)
    folder = path(f"{root}/{MANIFESTS}")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """version (0 before anything is published), run (the last to publish) and tables: by name, the run that built each and its stage."""
    known = versions(spark, root)
    version = version or (known[-1] if known else 0)
    if not version:
        return {"version": 0, "run": None, "tables": {}}
    return json.loads(spark.read.text(f"{root}/{MANIFESTS}/{version:08d}.json", wholetext=True).first()["value"])


def current(spark: SparkSession, root: str) -> str | None:
    """The run that published last, or None."""
    return manifest(spark, root)["run"]


def _swap(spark: SparkSession, root: str, before: dict, run_id: str, tables: dict) -> int:
    version = before["version"] + 1
    fs, path = _fs(spark, root)
    aside, place = path(f"{root}/{MANIFESTS}/_{version:08d}.{run_id}"), path(f"{root}/{MANIFESTS}/{version:08d}.json")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps({"version": version, "run": run_id, "tables": tables}, sort_keys=True).encode()))
    out.close()
    context = spark.sparkContext
    modes = context._gateway.new_array(context._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(root).toUri(), context._jsc.hadoopConfiguration()).rename(aside, place, modes)
    except Exception as e:
        fs.delete(aside, False)
        if versions(spark, root)[-1:] == [before["version"]]:
            raise
        raise PublishedMeanwhile(f"{root}: version {version} has been published by another run") from e
    return version


def built(spark: SparkSession, root: str, run_id: str, name: str, df: DataFrame) -> DataFrame:
    """Writes a table of a run before publish(), which is given None for it and takes it as it stands; gives what was written."""
    return written(df, f"{root}/run={run_id}/{name}")


def built_in_slices(spark: SparkSession, root: str, run_id: str, name: str, slices: int, rows: Callable[[Callable[..., DataFrame]], DataFrame]) -> DataFrame:
    """As built(), by in_slices()."""
    return in_slices(spark, f"{root}/run={run_id}/{name}", slices, rows)


def publish(spark: SparkSession, root: str, run_id: str, tables: dict[str, DataFrame | None], verify: Callable[[dict[str, DataFrame]], None] = lambda _: None, stage: str | None = None) -> None:
    """Writes ``tables`` under the run, verifies what was written, then publishes them; a failure leaves everything as it was.

    With ``stage`` they take the place of the tables which that stage published before, and the tables of other stages stay; a
    name that another stage has published is an error. Without, they are all that is published. A table that built() has
    written for this run is None here.
    """
    before = manifest(spark, root)
    others = {name: t for name, t in before["tables"].items() if t["stage"] != stage} if stage else {}
    taken = sorted(set(tables) & set(others))
    if taken:
        raise ValueError(f"{stage}: {', '.join(taken)} belong to {', '.join(sorted({str(others[t]['stage']) for t in taken}))}")
    for name, df in tables.items():
        if df is not None:
            built(spark, root, run_id, name, df)
    verify({name: spark.read.parquet(f"{root}/run={run_id}/{name}") for name in tables})
    _swap(spark, root, before, run_id, others | {name: {"run": run_id, "stage": stage} for name in tables})


def read_published(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table as it is published, or as it was in an earlier ``version`` that hasn't been cleared."""
    tables = manifest(spark, root, version)["tables"]
    if name not in tables:
        raise KeyError(f"{name} isn't published; {', '.join(sorted(tables)) or 'nothing'} is")
    return spark.read.parquet(f"{root}/run={tables[name]['run']}/{name}")


def show(spark: SparkSession, root: str, *names: str) -> None:
    """Temporary views of published tables, of all of one manifest where none is named."""
    tables = manifest(spark, root)["tables"]
    for name in names or tables:
        spark.read.parquet(f"{root}/run={tables[name]['run']}/{name}").createOrReplaceTempView(name)


def clear(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Deletes all manifests but the last ``keep``, and the runs that none of these names; gives the runs deleted."""
    fs, path = _fs(spark, root)
    known = versions(spark, root)
    used = {t["run"] for v in known[-keep:] for t in manifest(spark, root, v)["tables"].values()}
    gone = [n for n in (s.getPath().getName().removeprefix("run=") for s in fs.listStatus(path(root)) if s.getPath().getName().startswith("run=")) if n not in used]
    for v in known[:-keep]:
        fs.delete(path(f"{root}/{MANIFESTS}/{v:08d}.json"), False)
    for n in gone:
        fs.delete(path(f"{root}/run={n}"), True)
    return sorted(gone)


def retain(spark: SparkSession, root: str, *names: str) -> None:
    """Publishes no tables but ``names``, as they stand, and deletes the others and all earlier manifests."""
    before = manifest(spark, root)
    _swap(spark, root, before, before["run"], {name: before["tables"][name] for name in names})
    clear(spark, root, keep=1)
    for name, t in before["tables"].items():
        if name not in names:
            remove(spark, f"{root}/run={t['run']}/{name}")


class Reader:
    """Queries over published tables, which keeps the results of the last ``size`` while the version they read is published.

    A result is known by its SQL, its arguments and the version, so none outlives a publication: when the version moves all
    are given up and the views are made anew. Results are cached by Spark, spilling to disk, not held by the driver.
    """

    def __init__(self, spark: SparkSession, root: str, size: int = 512):
        self.spark, self.root, self.size, self.version, self.kept = spark, root, size, None, OrderedDict()
        self.hits = 0

    def query(self, sql: str, args: dict | list | None = None) -> DataFrame:
        """``sql`` with :name or ? for its arguments, over the tables by their names."""
        known = versions(self.spark, self.root)
        if self.version is None or known[-1:] != [self.version]:
            self.forget()
            self.version = known[-1] if known else 0
            show(self.spark, self.root)
        key = (sql, json.dumps(args, sort_keys=True, default=str))
        if key in self.kept:
            self.hits += 1
            self.kept.move_to_end(key)
            return self.kept[key]
        self.kept[key] = self.spark.sql(sql, args).persist()
        if len(self.kept) > self.size:
            self.kept.popitem(last=False)[1].unpersist()
        return self.kept[key]

    def forget(self) -> None:
        while self.kept:
            self.kept.popitem()[1].unpersist()


def append_history(df: DataFrame, root: str, name: str, run_id: str) -> None:
    """Results that outlive the run; writing a run again replaces its own part only."""
    df.write.mode("overwrite").parquet(f"{root}/history/{name}/run={run_id}")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys; null keys are equal. Columns are matched by name."""
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    kept = old.alias("o").join(new.select(*keys).distinct().alias("n"), same, "left_anti")
    return kept.unionByName(new)


def updated(df: DataFrame, where: str, values: dict[str, str]) -> DataFrame:
    """``df`` with the columns of ``values`` set to those SQL expressions in the rows that ``where`` holds for; all see the old row."""
    hit = F.coalesce(F.expr(where), F.lit(False))
    return df.select(*(F.when(hit, F.expr(values[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns))


def replace_slices(df: DataFrame, path: str, by: str) -> None:
    """Writes ``df`` partitioned by ``by`` and replaces the slices it holds; slices that it does not hold stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def delete(spark: SparkSession, root: str) -> None:
    """Deletes everything that was published at ``root``, and the databases of the catalogue that were made of it."""
    for d in spark.catalog.listDatabases():
        if d.locationUri and f"{root.split(':', 1)[-1].lstrip('/')}/catalogue/" in d.locationUri:
            spark.sql(f"DROP DATABASE IF EXISTS {d.name} CASCADE")
    remove(spark, root)


def expose(spark: SparkSession, root: str, database: str) -> list[str]:
    """A database of the catalogue whose tables are those published at ``root``; gives their names."""
    tables = manifest(spark, root)["tables"]
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{root}/catalogue/{database}'")
    for name, t in tables.items():
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
        spark.sql(f"CREATE TABLE {database}.{name} USING parquet LOCATION '{root}/run={t['run']}/{name}'")
    return sorted(tables)


def create_views(spark: SparkSession, database: str, views: dict[str, str], comments: dict[str, str]) -> SparkSession:
    """Views of a database, in order, each with its comment in the catalogue; their SQL names its tables and earlier views.

    Gives a session of their own, in which these names mean the database's and not temporary views of ``spark``.
    """
    own = spark.newSession()
    own.catalog.setCurrentDatabase(database)
    for name, sql in views.items():
        text = comments[name].replace("\\", "\\\\").replace("'", "\\'")
        own.sql(f"CREATE OR REPLACE VIEW {database}.{name} COMMENT '{text}' AS {sql}")
    return own


def introspected(spark: SparkSession, database: str) -> DataFrame:
    """name, kind (table or view), comment and n_columns of what a database holds, as the catalogue has them."""
    rows = [(t.name, "view" if t.tableType == "VIEW" else "table", t.description, len(spark.catalog.listColumns(f"{database}.{t.name}"))) for t in spark.catalog.listTables(database) if not t.isTemporary]
    return spark.createDataFrame(rows, "name string, kind string, comment string, n_columns int")


def assert_described(spark: SparkSession, database: str, comments: dict[str, str]) -> None:
    """Every view of the database has the comment that it is given here, and there is no other."""
    built = {r.name: r.comment for r in introspected(spark, database).filter("kind = 'view'").collect()}
    if built != comments:
        raise ValueError(f"views built and described differ: {sorted(set(built.items()) ^ set(comments.items()))}")
