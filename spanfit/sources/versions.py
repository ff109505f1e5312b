"""Published versions: tables that change together or not at all (K-01, K-04).

A root folder holds data in folders that are never written again, and manifests, one small file for each version, that
name the folders of a version's tables. Publishing writes new folders, reads them back, checks them, and only then renames
a manifest into place; a version exists once its manifest does. A run that ends anywhere before leaves readers with the
version before. Rolling back publishes an older version's folders again, so versions only ever go up.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_document(spark: SparkSession, path: str) -> object:
    """The JSON value of a small file."""
    fs, p = _files(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def write_document(spark: SparkSession, path: str, value: object, replace: bool = True) -> None:
    """Writes a small JSON file beside its place and renames it there: readers see the old file or the new one. replace=False: an error if there is one."""
    fs, p = _files(spark, path)
    _, aside = _files(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(aside, False)
    try:
        stream.write(bytearray(json.dumps(value, indent=2, sort_keys=True).encode() + b"\n"))
    finally:
        stream.close()
    try:
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
        rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE if replace else rename.NONE
        context.rename(context.makeQualified(aside), context.makeQualified(p), options)
    except Exception:
        fs.delete(aside, False)
        raise


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions published, in order."""
    fs, p = _files(spark, f"{root}/manifests")
    if not fs.exists(p):
        return []
    return sorted(int(m[1]) for f in fs.listStatus(p) if (m := re.fullmatch(r"(\d+)\.json", f.getPath().getName())))


def _manifest(spark: SparkSession, root: str, version: int | None) -> dict:
    known = versions(spark, root)
    if not known or version is not None and version not in known:
        raise LookupError(f"{root} has no version" + ("" if version is None else f" {version}"))
    return read_document(spark, f"{root}/manifests/{known[-1] if version is None else version:012d}.json")


def read_version(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, by name; of the last one by default."""
    tables = _manifest(spark, root, version)["tables"]
    return {name: spark.read.schema(T.StructType.fromJson(t["schema"])).parquet(f"{root}/{t['folder']}") for name, t in tables.items()}


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], good: Callable[[dict[str, DataFrame], dict[str, DataFrame]], bool]) -> int:
    """Writes tables as the next version and gives its number. good gets the tables as written and those of the version before ({} for the first).

    Tables that are not given stay those of the version before. What fails the check is an error, and changes nothing but a
    folder that no version names. Of two runs that publish at once one gets an error.
    """
    known = versions(spark, root)
    before = _manifest(spark, root, None)["tables"] if known else {}
    folder = f"data/{uuid.uuid4().hex}"
    entries, written = {}, {}
    for name, rows in tables.items():
        rows.write.parquet(f"{root}/{folder}/{name}")
        written[name] = spark.read.schema(rows.schema).parquet(f"{root}/{folder}/{name}")
        entries[name] = {"folder": f"{folder}/{name}", "schema": rows.schema.jsonValue()}
    if not good(written, read_version(spark, root) if known else {}):
        raise ValueError(f"the tables in {folder} fail the check; the last version stays")
    return _commit(spark, root, known, before | entries)


def _commit(spark: SparkSession, root: str, known: list[int], tables: dict) -> int:
    number = known[-1] + 1 if known else 1
    fs, p = _files(spark, f"{root}/manifests")
    fs.mkdirs(p)
    write_document(spark, f"{root}/manifests/{number:012d}.json", {"version": number, "tables": tables}, replace=False)
    return number


def roll_back(spark: SparkSession, root: str, version: int) -> int:
    """Publishes an older version's tables again, and gives the new number."""
    return _commit(spark, root, versions(spark, root), _manifest(spark, root, version)["tables"])


def vacuum(spark: SparkSession, root: str, keep: int) -> int:
    """Removes all but the last `keep` versions, and folders that none of these names; gives the number of folders removed. Not while a run publishes."""
    if keep < 1:
        raise ValueError("the last version is always kept")
    known = versions(spark, root)
    used = {t["folder"].rsplit("/", 1)[0] for v in known[-keep:] for t in _manifest(spark, root, v)["tables"].values()}
    fs, p = _files(spark, f"{root}/data")
    for v in known[:-keep]:
        fs.delete(_files(spark, f"{root}/manifests/{v:012d}.json")[1], False)
    gone = [f.getPath() for f in fs.listStatus(p) if f"data/{f.getPath().getName()}" not in used] if fs.exists(p) else []
    for f in gone:
        fs.delete(f, True)
    return len(gone)
