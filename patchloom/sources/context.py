"""Repositories as relations: file contents, safe archives, review packets, build descriptors, and their sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.functions.text import base_name, extension_of, file_role, folder_of, language_of_path
from patchloom.operators.packets import safe_files

#: Folders and extensions that a packet leaves out, descriptors of a build, folders that a build makes; limits.
EXCLUDED = (".git", ".gradle", ".idea", "target", "build", "node_modules", "dist", "out", "coverage")
BINARY = (".class", ".jar", ".zip", ".png", ".jpg", ".jpeg", ".gif", ".pdf", ".woff", ".woff2", ".ttf", ".ico", ".exe", ".dll")
DESCRIPTORS = ("pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts")
BUILD_EXCLUDED = (".git", ".gradle", ".idea", "target", "build", "node_modules", "dist", "out")
RELATION_TYPES = ("calls", "implements", "extends", "tests")
MOST_FILES, MOST_BYTES, MOST_FILE_BYTES = 2000, 25 << 20, 1_000_000


def contents_at(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """``wanted`` (path, ref) with the content that ``files`` (path, ref, content) has at that ref; null where there is none."""
    return wanted.join(files.select("path", "ref", "content"), ["path", "ref"], "left")


def repository_files(spark: SparkSession, folder: str) -> DataFrame:
    """path (relative), content (bytes) of all files below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.split("://", 1)[-1].rstrip("/") + "/"
    return rows.select(F.substring_index(F.col("path"), root, -1).alias("path"), "content")


def archive(spark: SparkSession, folder: str, most_files: int = 50_000, most_bytes: int = 1 << 30, most_file_bytes: int = 2 << 20) -> DataFrame:
    """path, n_bytes, status of a repository's files under its limits, as ``packets.safe_files`` has it."""
    return safe_files(repository_files(spark, folder), most_files, most_bytes, most_file_bytes)


def _within(path, folders: tuple[str, ...]):
    return F.exists(F.split(path, "/"), lambda x: x.isin(*folders))


def packet_files(files: DataFrame, revision: str, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES, most_file_bytes: int = MOST_FILE_BYTES) -> DataFrame:
    """revision, path, role, language, content of the files that a packet holds; more files or bytes than allowed are an error.

    Excluded folders, binary extensions and files that are too large are left out. ``files`` (path, content as text).
    """
    use = ~_within(F.col("path"), EXCLUDED) & ~extension_of(F.col("path")).isin(*BINARY) & (F.octet_length("content") <= most_file_bytes)
    rows = files.filter(use).select(F.lit(revision).alias("revision"), "path", file_role(F.col("path")).alias("role"), language_of_path(F.col("path")).alias("language"), "content")
    sums = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("b"))
    over = sums.select(F.when((F.col("n") > most_files) | (F.col("b") > most_bytes), F.raise_error(F.lit("the packet exceeds its limits"))).alias("__error"))
    return rows.join(F.broadcast(over), F.col("__error").isNull()).drop("__error")


def packet_relationships(symbols: DataFrame, relationships: DataFrame, revision: str) -> DataFrame:
    """from_id, to_id, type, evidence_path, evidence_line of relationships whose ends are both known; types outside the list are references."""
    known = symbols.select(F.col("stable_key").alias("k")).distinct()
    rows = relationships.join(known.withColumnRenamed("k", "from_key"), "from_key", "left_semi").join(known.withColumnRenamed("k", "to_key"), "to_key", "left_semi")
    named = lambda c: F.concat(F.lit(f"{revision}:"), c)
    kind = F.when(F.lower("type").isin(*RELATION_TYPES), F.lower("type")).otherwise("references")
    return rows.select(named("from_key").alias("from_id"), named("to_key").alias("to_id"), kind.alias("type"), F.replace(F.col("source_path"), F.lit("\\"), F.lit("/")).alias("evidence_path"), F.col("source_line").alias("evidence_line"))


def packet_identity(files: DataFrame) -> DataFrame:
    """One row: digest and packet_id of a packet's files. Contents are hashed where they stand; only hashes meet."""
    rows = files.select(F.sha2(F.concat_ws("\n", "revision", "path", "role", F.coalesce("language", F.lit("")), F.sha2(F.coalesce("content", F.lit("")), 256)), 256).alias("h"))
    digest = rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("digest"))
    return digest.withColumn("packet_id", F.concat(F.lit("review-context-"), F.substring("digest", 1, 24)))


def build_modules(files: DataFrame, key: str) -> DataFrame:
    """``key``, module, system, descriptors, model_hash: each folder with a build file, and what builds the repository.

    ``files`` (``key``, path, content). MAVEN, GRADLE, MIXED or UNKNOWN; a repository without a build file has its root as its module,
    and one without any descriptor is UNKNOWN. The hash is over all descriptors' paths and contents.
    """
    name = base_name(F.col("path"))
    rows = files.withColumn("__d", name.isin(*DESCRIPTORS) & ~_within(F.col("path"), BUILD_EXCLUDED))
    maven, gradle = F.max(F.col("__d") & (name == "pom.xml")), F.max(F.col("__d") & (name != "pom.xml"))
    system = F.when(maven & gradle, "MIXED").when(maven, "MAVEN").when(gradle, "GRADLE").otherwise("UNKNOWN")
    content = F.concat_ws("\n", "path", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256))
    model = rows.groupBy(key).agg(system.alias("system"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.when(F.col("__d"), content))), "\n"), 256).alias("model_hash"), F.max(F.col("__d") & ~name.startswith("settings")).alias("__some"))
    own = rows.filter("__d").withColumn("module", folder_of(F.col("path"))).groupBy(key, "module").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("descriptors"), F.max(~name.startswith("settings")).alias("__build")).filter("__build").drop("__build")
    bare = model.filter("NOT __some").select(key, F.lit("").alias("module"), F.lit("").alias("descriptors"))
    return own.unionByName(bare).join(model.drop("__some"), key)


def write_cases(cases: DataFrame, path: str, key: str) -> DataFrame:
    """Writes cases as JSON lines and returns their summary (``key``, cases); a folder that exists is never overwritten.

    The rows go to a folder beside it, which is renamed when it is whole, so a reader sees all of them or none.
    """
    spark = cases.sparkSession
    partial = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    target = jvm_path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target):
        raise FileExistsError(path)
    cases.write.json(partial)
    if not files.rename(jvm_path(partial), target):
        raise OSError(f"{partial} can't be renamed")
    return spark.read.schema(cases.schema).json(path).groupBy(key).agg(F.count("*").alias("cases"))
