"""Prediction store: one table a run, all bucketed alike by (split, id).

Every run is hashed into the same buckets when it is written, so aligning any
number of runs and joining their folds reads bucket by bucket and shuffles
nothing (SURVEY J1, S9). A run is written once and joined many times: the one
shuffle is paid by the writer.

Layout: ``<path>/<run>-<attempt>`` holds a run's rows, ``<path>/store-<version>.json``
the number of buckets and the folder that counts for each run. A new version of this
manifest is written last and whole, so a run whose write broke off is not part of the
store; of two writers that take the same version, the later one raises. The catalog holds one external table a folder, named by the
store's path and created where it is missing, so a new session only needs the path.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.sources.io import list_names, path_exists, read_text, write_text_atomically

KEYS = ("split", "id")
FOLDS = "_folds"


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The newest manifest and its version; version 0 where there is no store yet."""
    if not path_exists(spark, path):
        return 0, {"tables": {}}
    named = [n[6:-5] for n in list_names(spark, path) if n.startswith("store-") and n.endswith(".json")]
    version = max((int(n) for n in named if n.isdigit()), default=0)
    return version, json.loads(read_text(spark, f"{path.rstrip('/')}/store-{version}.json")) if version else {"tables": {}}


def _table(path: str, folder: str) -> str:
    return f"store_{hashlib.md5(path.rstrip('/').encode()).hexdigest()[:12]}_" + "".join(c if c.isalnum() else "_" for c in folder.lower())


def _put(df: DataFrame, path: str, name: str, buckets: int) -> None:
    spark = df.sparkSession
    n = _manifest(spark, path)[1].get("buckets", buckets)
    folder = f"{name}-{uuid.uuid4().hex[:12]}"
    (
        df.repartition(n, *KEYS)  # the same hash as the buckets', so a bucket is one file
        .write.bucketBy(n, *KEYS)
        .sortBy(*KEYS)
        .option("path", f"{path.rstrip('/')}/{folder}")
        .format("parquet")
        .saveAsTable(_table(path, folder))
    )
    version, held = _manifest(spark, path)
    if held.setdefault("buckets", n) != n:
        raise FileExistsError(f"another writer has opened the store {path} with {held['buckets']} buckets")
    held["tables"][name] = {"folder": folder, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)}
    write_text_atomically(spark, f"{path.rstrip('/')}/store-{version + 1}.json", json.dumps(held))


def write_run(df: DataFrame, path: str, run: str, buckets: int = 200) -> None:
    """Add or replace one run: ``split, id, y, pred``. The first run fixes the number of buckets."""
    if run == FOLDS or not run or "/" in run:
        raise ValueError(f"{run!r} can't be the name of a run")
    _put(df.select("split", "id", "y", "pred"), path, run, buckets)


def write_folds(df: DataFrame, path: str, buckets: int = 200) -> None:
    """Add or replace the folds of the store's rows: ``split, id, fold``."""
    _put(df.select("split", "id", "fold"), path, FOLDS, buckets)


def _read(spark: SparkSession, path: str, held: dict, name: str) -> DataFrame:
    t = held["tables"][name]
    table = _table(path, t["folder"])
    if not spark.catalog.tableExists(table):
        keys = ", ".join(KEYS)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({t['schema']}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
            f"INTO {held['buckets']} BUCKETS LOCATION '{path.rstrip('/')}/{t['folder']}'"
        )
    return spark.table(table)


def runs(spark: SparkSession, path: str) -> list[str]:
    """The store's runs in order of name; an empty list where there is no store."""
    return sorted(set(_manifest(spark, path)[1]["tables"]) - {FOLDS})


def align(spark: SparkSession, path: str, names: list[str] | None = None, folds: bool = False) -> DataFrame:
    """``split, id, y, <run>...`` of the ids that every run holds, with ``fold`` if asked (null outside the folds).

    An id that a run holds twice, or whose target differs between runs, raises when it is
    read. All groupings and joins are by (split, id), which the buckets already
    satisfy: the plan has no exchange, whatever the number of runs.
    """
    held = _manifest(spark, path)[1]
    names = sorted(set(held["tables"]) - {FOLDS}) if names is None else names
    missing = [n for n in names if n not in held["tables"]]
    if missing or not names:
        raise FileNotFoundError(f"runs not in the store {path}: {missing or 'none asked or held'}")
    twice = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("an id is repeated in a run")).cast("double"))
    out = None
    for k, name in enumerate(names):
        one = _read(spark, path, held, name).groupBy(*KEYS).agg(twice.otherwise(F.max("pred")).alias(name), F.max("y").alias(f"__y{k}"))
        out = one if out is None else out.hint("merge").join(one.hint("merge"), list(KEYS))
    y = F.col("__y0")
    for k in range(1, len(names)):
        y = F.when(~F.col("__y0").eqNullSafe(F.col(f"__y{k}")), F.raise_error(F.lit("target differs between runs")).cast("int")).otherwise(y)
    if folds:
        if FOLDS not in held["tables"]:
            raise FileNotFoundError(f"no folds in the store {path}")
        out = out.hint("merge").join(_read(spark, path, held, FOLDS).hint("merge"), list(KEYS), "left")
    return out.select(*KEYS, y.alias("y"), *names, *(["fold"] if folds else []))


def detach(spark: SparkSession, path: str) -> None:
    """Take the store's tables out of the catalog; they are external, so the files stay."""
    for t in _manifest(spark, path)[1]["tables"].values():
        spark.sql(f"DROP TABLE IF EXISTS {_table(path, t['folder'])}")
