"""Reading and writing relations: Parquet tables, JSON lines that must be whole, and keyed snapshots."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from patchloom.sources import graphs


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def replay_cases(spark: SparkSession, path: str, schema: StructType | str, key: str) -> DataFrame:
    """JSON lines under a fixed schema; a malformed line or a repeated key is an error, blank lines are not."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    again = rows.groupBy(key).count().filter("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"{key} {again[0][0]!r} stands more than once")
    return rows


#: Relations that parsers and scans outside this package give, as they must come.
SCHEMAS = {
    "changed_files": "path string, previous_path string, status string, additions int, deletions int, patch string",
    "code_symbols": "snapshot_id string, stable_key string, path string, kind string, name string, qualified_name string, start_line int, end_line int, signature string, content_hash string, exported boolean",
    "code_edges": "snapshot_id string, from_key string, to_key string, type string, confidence double, source_path string, source_line int",
    "semantic_symbols": "stable_key string, kind string, qualified_name string, signature string, path string, start_line int, end_line int, test_source boolean, type_resolved boolean",
    "semantic_relationships": "ordinal int, from_key string, to_key string, type string, source_path string, source_line int, confidence double, type_resolved boolean",
}
_RULES = {
    "changed_files": "path IS NOT NULL AND coalesce(additions, 0) >= 0 AND coalesce(deletions, 0) >= 0",
    "code_symbols": "stable_key IS NOT NULL AND start_line > 0 AND end_line >= start_line",
    "code_edges": "from_key IS NOT NULL AND to_key IS NOT NULL AND confidence BETWEEN 0 AND 1",
    "semantic_symbols": "stable_key IS NOT NULL AND start_line > 0 AND end_line >= start_line",
    "semantic_relationships": "from_key IS NOT NULL AND to_key IS NOT NULL AND confidence BETWEEN 0 AND 1",
}


def conforming(rows: DataFrame, relation: str) -> DataFrame:
    """``rows`` with just the columns of a relation. A missing column or another type is an error now, a row that breaks its rule when it is read."""
    wanted = StructType.fromDDL(SCHEMAS[relation])
    for field in wanted:
        if field.name not in rows.columns or rows.schema[field.name].dataType != field.dataType:
            raise ValueError(f"{relation} needs {field.name} as {field.dataType.simpleString()}")
    broken = F.raise_error(F.lit(f"a row of {relation} breaks its rule")).cast("boolean")
    return rows.select(*wanted.names).filter(F.when(F.coalesce(F.expr(_RULES[relation]), F.lit(False)), F.lit(True)).otherwise(broken))


def relation(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A relation that a scan has landed as JSON lines: read under its schema, malformed lines an error."""
    return conforming(spark.read.schema(SCHEMAS[name]).option("mode", "FAILFAST").json(path), name)


def save_index(spark: SparkSession, header: DataFrame, children: DataFrame, folder: str, key: str) -> None:
    """Writes a snapshot's children and its header (one row with a ``status``) as a new version, and makes it the current one of ``key`` in one step.

    Whoever reads meanwhile, or after a failure on the way, has the version before, with all of its children.
    """
    facts = header.first().asDict()
    graphs.publish(spark, folder, key, {"children": children}, status=facts["status"], facts={k: str(v) for k, v in facts.items()})


def load_ready(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """The children of a snapshot whose header says that it is ready; none of any other. A key that was never saved is an error."""
    found = graphs.manifest(spark, folder, key)
    if found is None:
        raise KeyError(key)
    children = graphs.opened(spark, folder, key, "children")
    return spark.createDataFrame([], StructType.fromJson(found["schemas"]["children"])) if children is None else children


def snapshot_key(repository: str, commit: str, adapter: str, build: str) -> str:
    return hashlib.sha256("\n".join((repository, commit, adapter, build)).encode()).hexdigest()


def save_snapshot(rows: DataFrame, path: str, key: str) -> None:
    """Replaces the rows of one snapshot, and of no other."""
    rows.withColumn("snapshot_key", F.lit(key)).write.option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_key").mode("overwrite").parquet(path)


def load_snapshot(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Rows of one snapshot; other partitions aren't read."""
    return spark.read.parquet(path).filter(F.col("snapshot_key") == key).drop("snapshot_key")
