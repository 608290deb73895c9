"""Feature-table and report I/O.

A feature table is written once, partitioned by the split flag, next to a
small ``meta.json`` (features, categorical features, counts, id/target
names, settings). Reading it back needs no type inference: Parquet keeps the
types, and the metadata restores the feature lists.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.sources.loans import ID, SPLIT, TARGET

META = "meta.json"
DATA = "data"


def _join(*parts: str) -> str:
    return "/".join([parts[0].rstrip("/"), *parts[1:]])


def _file(spark: SparkSession, path: str):
    """The Hadoop file system that holds ``path``, and the path in it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file beside the data, in whatever store the data is."""
    fs, p = _file(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_text_atomically(spark: SparkSession, path: str, text: str) -> None:
    """The file appears whole or not at all: written beside its place, then renamed. Its folder must be this writer's own."""
    fs, p = _file(spark, path)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    write_text(spark, tmp, text)
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(tmp), p):
        remove_path(spark, tmp)
        raise FileExistsError(path)


def list_names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _file(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)]


def remove_path(spark: SparkSession, path: str) -> None:
    fs, p = _file(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def apply_types(df: DataFrame, profile: DataFrame) -> DataFrame:
    """P13 cast each profiled column to its recommended Spark type before writing."""
    rec = {r["col"]: r["spark_type"] for r in profile.select("col", "spark_type").collect()}
    return df.select(*[F.col(c).cast(rec[c]).alias(c) if c in rec else F.col(c) for c in df.columns])


def write_feature_table(df: DataFrame, path: str, features: list[str], cat_features: list[str],
                        meta_extra: dict | None = None) -> dict:
    """S5 data partitioned by the split flag, then meta.json; returns the metadata.

    Rows are counted from the written files; the metadata comes last, so a table
    that has it is complete."""
    spark = df.sparkSession
    data = _join(path, DATA)
    df.write.mode("overwrite").partitionBy(SPLIT).parquet(data)
    counts = {r[SPLIT]: r["n"] for r in spark.read.parquet(data).groupBy(SPLIT).agg(F.count(F.lit(1)).alias("n")).collect()}
    meta = {"format": "parquet", "features": features, "cat_features": cat_features,
            "n_train": int(counts.get(1, 0)), "n_test": int(counts.get(0, 0)),
            "id_col": ID, "target": TARGET}
    meta.update(meta_extra or {})
    write_text(spark, _join(path, META), json.dumps(meta, ensure_ascii=False, indent=2, default=str))
    return meta


def load_feature_table(spark: SparkSession, path: str):
    """S4 (train, test, features, cat_features, meta); FileNotFoundError when a part is missing."""
    meta_path, data = _join(path, META), _join(path, DATA)
    if not path_exists(spark, meta_path) or not path_exists(spark, data):
        raise FileNotFoundError(f"incomplete feature table at {path}")
    meta = json.loads(read_text(spark, meta_path))
    df = spark.read.parquet(data)
    train = df.filter(F.col(SPLIT) == 1).drop(SPLIT)
    test = df.filter(F.col(SPLIT) == 0).drop(SPLIT, meta.get("target", TARGET))
    return train, test, meta["features"], meta["cat_features"], meta


def typed_reload(df: DataFrame, meta: dict) -> DataFrame:
    """S3 restore numeric types of a table read as text: every listed
    non-categorical feature becomes a double (unparsable → null)."""
    cats = set(meta.get("cat_features", []))
    return df.select(*[
        F.col(c).cast("string").try_cast("double").alias(c)
        if c in meta.get("features", []) and c not in cats else F.col(c)
        for c in df.columns
    ])


def input_files(spark: SparkSession, paths: list[str]) -> list[list]:
    """Every data file under the paths: [path, bytes, modification time], by path."""
    out = []
    for path in paths:
        fs, p = _file(spark, path)
        files = fs.listFiles(p, True)  # FileNotFoundException if there is none
        while files.hasNext():
            f = files.next()
            if not f.getPath().getName().startswith(("_", ".")):
                out.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return sorted(out)


def cache_key(files: list[list], settings) -> str:
    """What a cached table depends on: its input files and the settings it is built with."""
    told = json.dumps({"files": files, "settings": settings}, sort_keys=True, default=str)
    return hashlib.sha256(told.encode()).hexdigest()[:32]


def _schema_hash(df: DataFrame) -> str:
    return hashlib.sha256(",".join(sorted(f"{n}:{t}" for n, t in df.dtypes)).encode()).hexdigest()


def cache_or_build(spark: SparkSession, path: str, build, inputs: list[str] | None = None, settings=None):
    """S6/S7 the feature table for these input files and settings: read, or built and kept.

    Each build goes to a folder of its own under ``tables/``. Its manifest
    (``manifests/<key>.json``: input files with size and time, settings, schema
    hash, folder) is written last, by a rename, so a half-written table is never
    read. Changed inputs or settings are another key and get another table. Of two
    writers of one key both tables are whole, and both read the one whose manifest is
    there in the end. A manifest whose table is gone or has another schema is
    built anew; an unreadable one is an error. ``build()`` returns a
    ``FeatureTable``; ``inputs`` are folders or files; ``settings`` is anything JSON
    can tell. Returns (status, tuple).
    """
    files = input_files(spark, inputs or [])
    manifest = _join(path, "manifests", f"{cache_key(files, settings)}.json")
    if path_exists(spark, manifest):
        told = json.loads(read_text(spark, manifest))
        if (table := _cached(spark, path, told)) is not None:
            return {"ok": True, "built": False}, table
        remove_path(spark, manifest)
    ft = build()
    folder = uuid.uuid4().hex
    own = _join(path, "tables", folder)
    write_feature_table(ft.df, own, ft.features, ft.cat_features, ft.meta)
    told = {"folder": folder, "files": files, "settings": settings, "schema": _schema_hash(spark.read.parquet(_join(own, DATA)))}
    _file(spark, manifest)[0].mkdirs(_file(spark, _join(path, "manifests"))[1])
    if not path_exists(spark, manifest):
        try:
            write_text_atomically(spark, manifest, json.dumps(told, default=str))
        except FileExistsError:
            pass  # another writer was first; its table is as good
    told = json.loads(read_text(spark, manifest))
    if told["folder"] != folder:
        remove_path(spark, own)
    return {"ok": True, "built": True}, load_feature_table(spark, _join(path, "tables", told["folder"]))


def _cached(spark: SparkSession, path: str, told: dict):
    try:
        table = load_feature_table(spark, _join(path, "tables", told["folder"]))
    except FileNotFoundError:
        return None
    whole = spark.read.parquet(_join(path, "tables", told["folder"], DATA))
    return table if _schema_hash(whole) == told["schema"] else None


def prune_cache(spark: SparkSession, path: str, keep: list[str]) -> list[str]:
    """Delete the cached tables whose key isn't in ``keep``, manifests first; the deleted keys. No writer may be at work."""
    names = list_names(spark, _join(path, "manifests")) if path_exists(spark, _join(path, "manifests")) else []
    held, gone = set(), []
    for name in sorted(n for n in names if n.endswith(".json")):
        key, manifest = name.removesuffix(".json"), _join(path, "manifests", name)
        if key in keep:
            held.add(json.loads(read_text(spark, manifest))["folder"])
        else:
            remove_path(spark, manifest)
            gone.append(key)
    if path_exists(spark, _join(path, "tables")):
        for folder in list_names(spark, _join(path, "tables")):
            if folder not in held:
                remove_path(spark, _join(path, "tables", folder))
    return gone


def require_columns(df: DataFrame, cols: list[str]) -> None:
    """S12 raise listing (up to 10 of) the missing feature columns."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        more = f" (+{len(missing) - 10} more)" if len(missing) > 10 else ""
        raise KeyError(f"missing feature columns: {missing[:10]}{more}")


def write_reports(reports: dict[str, DataFrame], out_dir: str, top: int = 5, order: dict[str, list] | None = None) -> str:
    """S10 one Parquet table per report plus a markdown summary of the first
    ``top`` rows of each, in the report's ``order`` (else by all its columns)."""
    lines = ["# Audit summary", ""]
    spark = None
    for name, df in reports.items():
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(_join(out_dir, name))
        rows = spark.read.parquet(_join(out_dir, name)).orderBy(*(order or {}).get(name, df.columns)).limit(top).collect()
        lines += [f"## {name}", "", "| " + " | ".join(df.columns) + " |",
                  "|" + "---|" * len(df.columns)]
        lines += ["| " + " | ".join(str(v) for v in r) + " |" for r in rows]
        lines.append("")
    text = "\n".join(lines)
    if spark is not None:
        write_text(spark, _join(out_dir, "summary.md"), text)
    return text


def write_sidecar_lists(spark: SparkSession, out_dir: str, **lists: list[str]) -> None:
    """S11 plain-text lists (features.txt, cat_features.txt, kept/dropped runs)."""
    for name, items in lists.items():
        write_text(spark, _join(out_dir, f"{name}.txt"), "\n".join(items) + ("\n" if items else ""))
