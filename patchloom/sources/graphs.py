"""A code graph stored for its joins, and published whole: edges in buckets of their target, symbols in buckets of their key.

A version is a folder of its own, written first; a manifest of one line then names it. Replacing the manifest is one rename, so a
reader finds the old version or the new one with all its parts, whatever fails between. Tables are described again from the manifest
when a graph is opened, so no catalog has to outlive a session. Reads by key need no exchange of edges: only what is
searched for is dealt by key, or broadcast by Spark where it is small.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Columns by which the parts of a graph are dealt into buckets and sorted.
PARTS = {"edges": "to_key", "symbols": "stable_key"}
#: Tasks that write a part, where it has fewer buckets: a few buckets are sorted in shares, which become files of their own.
LEAST_TASKS = 64


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside ``path`` and renames it over it in one step."""
    place, files = _files(spark, path)
    partial = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = files.create(partial, True)
    out.write(bytearray(text.encode()))
    out.close()
    qualified = files.makeQualified(place)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(files.makeQualified(partial), qualified, options)


def _get(spark: SparkSession, path: str) -> dict | None:
    place, files = _files(spark, path)
    if not files.exists(place):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def publish(spark: SparkSession, folder: str, key: str, parts: dict[str, DataFrame], buckets: int = 64, status: str = "ready", facts: dict | None = None) -> dict:
    """Writes ``parts`` (edges, symbols, or any other name) as a new version of the graph ``key`` and makes it the current one.

    ``facts`` are kept in the manifest. Parts named in PARTS are bucketed and sorted; others are plain. Rows with a null key stay in a
    bucket of their own. The version that was current stays on disk until ``retire``, so those who read it go on.
    """
    version = f"{folder}/versions/{uuid.uuid4().hex}"
    schemas = {}
    for name, rows in parts.items():
        writer = rows.write.format("parquet")
        if name in PARTS:
            table = f"stored_{uuid.uuid4().hex}"
            tasks = buckets * max(1, LEAST_TASKS // buckets)  # a multiple of the buckets: a task's rows all belong to one
            rows.repartition(tasks, PARTS[name]).write.format("parquet").bucketBy(buckets, PARTS[name]).sortBy(PARTS[name]).option("path", f"{version}/{name}").saveAsTable(table)
            spark.sql(f"DROP TABLE {table}")  # the table is external: its files stay
        else:
            writer.save(f"{version}/{name}")
        schemas[name] = rows.schema.jsonValue()
    manifest = {"key": key, "status": status, "version": version, "buckets": buckets, "schemas": schemas, "facts": facts or {}}
    _put(spark, f"{folder}/manifests/{key}.json", json.dumps(manifest))
    return manifest


def manifest(spark: SparkSession, folder: str, key: str) -> dict | None:
    """What the current version of the graph ``key`` is, or None."""
    return _get(spark, f"{folder}/manifests/{key}.json")


def opened(spark: SparkSession, folder: str, key: str, part: str) -> DataFrame | None:
    """A part of the current version of the graph ``key``; None if there is none that is ready."""
    found = manifest(spark, folder, key)
    if found is None or found["status"] != "ready":
        return None
    schema = StructType.fromJson(found["schemas"][part])
    path = f"{found['version']}/{part}"
    if part not in PARTS:
        return spark.read.schema(schema).parquet(path)
    table = f"opened_{found['version'].rpartition('/')[2]}_{part}"
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{PARTS[part]}`) SORTED BY (`{PARTS[part]}`) INTO {found['buckets']} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def retire(spark: SparkSession, folder: str) -> int:
    """Deletes versions that no manifest names, and how many they were. Run it when no reader of an old version is left."""
    place, files = _files(spark, f"{folder}/versions")
    if not files.exists(place):
        return 0
    listed, jobs = _files(spark, f"{folder}/manifests")
    current = {_get(spark, x.getPath().toString())["version"].rpartition("/")[2] for x in jobs.listStatus(listed) if x.getPath().getName().endswith(".json")} if jobs.exists(listed) else set()
    gone = [x.getPath() for x in files.listStatus(place) if x.getPath().getName() not in current]
    for path in gone:
        files.delete(path, True)
    return len(gone)
