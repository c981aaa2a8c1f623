"""Small JSON documents that say which files of a folder count, written in one step each.

What several tables or many files hold is written first, under names of its own; then one
manifest names it.  Readers follow manifests, so they see all of it or nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def store_of(spark: SparkSession, path: str):
    """A path and its file system, whatever store it lies in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder, sorted; nothing where there is none."""
    path, store = store_of(spark, folder)
    return sorted(f.getPath().getName() for f in store.listStatus(path)) if store.exists(path) else []


def committed(spark: SparkSession, folder: str) -> list[str]:
    """The names of all manifests of a folder, sorted."""
    return [n[: -len(".json")] for n in names_in(spark, folder) if n.endswith(".json") and not n.startswith(".")]


def load(spark: SparkSession, folder: str, name: str) -> dict:
    path, store = store_of(spark, f"{folder}/{name}.json")
    data = spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(store.open(path))
    return json.loads(bytes(data).decode())


def commit(spark: SparkSession, folder: str, name: str, content: dict) -> None:
    """The manifest appears under its name in one step; a name that exists is an error."""
    draft, store = store_of(spark, f"{folder}/.{name}.draft")
    final, _ = store_of(spark, f"{folder}/{name}.json")
    if store.exists(final):
        raise FileExistsError(f"{folder}/{name}.json")
    out = store.create(draft, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if not store.rename(draft, final):
        raise OSError(f"{folder}/{name}.json could not be written")
