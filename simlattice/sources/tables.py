"""Stored tables and study inputs: lookups in an index, snapshots, CSV and key=value files, advisories, findings."""

from __future__ import annotations

import json
import os
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


def table(spark: SparkSession, index: str, name: str) -> DataFrame:
    """A table of the index, with its schema even where it has no row."""
    schema = T.StructType.fromJson(json.loads(spark.read.text(f"{index}/_schemas/{name}").first()[0]))
    return spark.read.schema(schema).parquet(f"{index}/{name}").drop("batch")


def clusters(spark: SparkSession, index: str, tier: str | None = None) -> DataFrame:
    """The stored clusters, of one tier if given; the tier is a partition, so others aren't read."""
    d = table(spark, index, "clusters")
    return d if tier is None else d.where(F.col("tier") == tier)


def first_stage_with_rows(spark: SparkSession, index: str, stages: tuple[str, ...] = ("identified", "collapsed")) -> tuple[DataFrame, str]:
    """The clusters of the first stage that has any, and its name; of the last if none has."""
    d = table(spark, index, "clusters")
    for s in stages:
        found = d.where(F.col("stage") == s)
        if not found.isEmpty():
            return found, s
    return found, s


def cluster_by_shape(spark: SparkSession, index: str, shape: str) -> DataFrame:
    return table(spark, index, "clusters").where(F.col("shape_hash") == shape)


def cluster_by_ordinal(spark: SparkSession, index: str, tier: str, ordinal: int) -> DataFrame:
    return clusters(spark, index, tier).where(F.col("ordinal") == ordinal)


def cluster_count(spark: SparkSession, index: str, tier: str) -> int:
    return clusters(spark, index, tier).count()


def orphans(spark: SparkSession, index: str, lang: str) -> DataFrame:
    """Near misses of a language; no row, rather than an error, where none were stored."""
    return table(spark, index, "near_misses").where(F.col("lang") == lang)


SNAPSHOT = "package string, func string, file string, line int, body string, candidates array<struct<cluster_id: string, score: double, common_shape: string>>"


def snapshots(spark: SparkSession, folder: str, releases: DataFrame) -> DataFrame:
    """(tag, idx, package, func, file, cluster, score) from a study's files outliers-<tag>.json, each a list; bad files give nothing."""
    try:
        d = spark.read.schema(SNAPSHOT).option("multiLine", "true").option("mode", "PERMISSIVE").json(f"{folder}/outliers-*.json").withColumn("tag", F.regexp_extract(F.input_file_name(), r"outliers-(.+)\.json$", 1))
    except AnalysisException:  # no such file
        d = spark.createDataFrame([], SNAPSHOT + ", tag string")
    best = F.get("candidates", F.lit(0))
    d = d.where("package is not null or func is not null")
    text = lambda c: F.coalesce(c, F.lit(""))
    return d.join(releases.select("tag", "idx"), "tag").select("tag", "idx", text(F.col("package")).alias("package"), text(F.col("func")).alias("func"), text(F.col("file")).alias("file"), text(best["cluster_id"]).alias("cluster"), F.coalesce(best["score"], F.lit(0.0)).alias("score"))


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header; a file that isn't there has no rows."""
    try:
        return spark.read.option("header", "true").schema(", ".join(f"{f.split()[0]} string" for f in schema.split(", "))).csv(path).select(*[coerced(F.col(f.split()[0]), f.split()[1]).alias(f.split()[0]) for f in schema.split(", ")])
    except AnalysisException:
        return spark.createDataFrame([], schema)


def coerced(value: Column, kind: str) -> Column:
    """The value as a number, 0 if it isn't one; texts stay."""
    return F.coalesce(value, F.lit("")) if kind == "string" else F.coalesce(value.try_cast(kind), F.lit(0).cast(kind))


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of lines 'key=value'; other lines are left out."""
    d = spark.read.text(path).where(F.col("value").contains("="))
    return d.select(F.trim(F.regexp_extract("value", "^([^=]*)=", 1)).alias("key"), F.trim(F.regexp_extract("value", "^[^=]*=(.*)$", 1)).alias("value"))


def head_commit(repo: str) -> str:
    """The commit that a checkout is at; '' if there is none, or no git."""
    try:
        return subprocess.run(["git", "-C", repo, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10).stdout.strip() if os.path.isdir(repo) else ""
    except (OSError, subprocess.SubprocessError):
        return ""


def advisories(spark: SparkSession, path: str) -> DataFrame:
    """Advisories (id, summary, aliases, cwes) from JSON files that someone fetched, one for each id."""
    return spark.read.schema("id string, summary string, aliases array<string>, cwes array<string>").option("multiLine", "true").json(path).where("id is not null").dropDuplicates(["id"])


def advisory_names(module: Column) -> Column:
    """The names under which advisories may list a Go module: itself, its first major version, and the versions 2 to 9 beside it."""
    base = F.regexp_replace(module, "/v[0-9]+$", "")
    return F.array_distinct(F.concat(F.array(module, base), F.transform(F.sequence(F.lit(2), F.lit(9)), lambda n: F.concat(base, F.lit("/v"), n.cast("string")))))


def advisories_of(modules: DataFrame, published: DataFrame) -> DataFrame:
    """(module, id, summary, fixed): published advisories (id, name, summary, fixed) of each module, or of a version beside it, once."""
    d = modules.select("module", F.explode(advisory_names(F.col("module"))).alias("name")).join(published, "name")
    return d.dropDuplicates(["module", "id"]).select("module", "id", F.substring(F.coalesce("summary", F.lit("")), 1, 200).alias("summary"), F.array_sort(F.array_distinct(F.coalesce("fixed", F.array().cast("array<string>")))).alias("fixed"))


FINDING = "id string, pass string, cwe string, cwe_name string, title string, severity string, confidence string, cluster_id string, package string, function string, location string, signal string, reason string, assumption string, blast_radius array<string>, suggested_fix string, confirm_with string, leverage string, leverage_reason string, sast_overlap string, known_status string, related_advisories array<string>, verification struct<status: string, checks: string, corrected_location: string, notes: string>"


def findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings from JSON: a list of them, or an object with the list under 'findings'."""
    d = spark.read.schema(f"{FINDING}, findings array<struct<{', '.join(x.replace(' ', ': ', 1) for x in _split(FINDING))}>>").option("multiLine", "true").json(path)
    nested = d.where("findings is not null").select(F.explode("findings").alias("f")).select("f.*")
    return d.where("findings is null").drop("findings").unionByName(nested).where("id is not null or title is not null")


def _split(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]


def shapes_in_page(pages: DataFrame, column: str = "html") -> DataFrame:
    """(shape_hash): hashes that report pages show, each once."""
    return pages.select(F.explode(F.regexp_extract_all(F.col(column), F.lit('class="shape">([0-9a-f]+)'), F.lit(1))).alias("shape_hash")).distinct()
