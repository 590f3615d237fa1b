"""Adapters: tables of other kinds as function rows, so that every analysis runs on them.

Each takes whole tables and whole texts. Codes are the first 4 hex digits of an MD5, modulo 94: other engines find the same, and a
code fits one ASCII character. Null keys and texts: no row. An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import CODE

ALPHABET = 94


def code(text: Column) -> Column:
    return (F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("int") % ALPHABET).cast("int")


def _rows(d: DataFrame) -> DataFrame:
    """Function rows from columns fn_id, name, package, file_path, lang, token_seq, direct_imports, call_targets."""
    t, n = F.col("token_seq"), lambda *names: S.count_token(F.col("token_seq"), *names).cast("int")
    features = F.struct(
        (1 + n("IF", "FOR", "RANGE", "CASE", "COMM", "GOTO")).alias("cyclomatic_complexity"), n("SWITCH", "SELECT").alias("nesting_depth"), n("RETURN").alias("early_returns"),
        F.struct(n("DEFER").alias("defer")).alias("control_flow"), n("CALL", "CALL_PKG", "CALL_METHOD").alias("outbound_calls"), n("GO").alias("goroutine_spawns"),
        F.array_contains(t, CODE["TYPE_ASSERT"]).alias("has_context_param"), F.array_contains(t, CODE["THROW"]).alias("has_error_return"),
    )
    unique = lambda c: F.array_sort(F.array_distinct(F.array_compact(F.col(c)))).alias(c)
    return d.select(
        F.col("fn_id").cast("long").alias("fn_id"), "name", "package", "file_path", "lang", F.lit(1).alias("start_line"), features.alias("features"), "token_seq", S.window_hashes(t).alias("token_seq_hash"),
        unique("direct_imports"), unique("call_targets"), F.lit(False).alias("generated_code"), F.lit(False).alias("test_code"), F.lit(False).alias("is_constructor"), F.lit("").alias("body"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: a token for each sentence; the sentences' first words are the imports, their last words the calls."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null and text is not null")
    parts = F.filter(F.transform(F.regexp_extract_all(F.lower("text"), F.lit(r"[^.!?\n\r]+"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")
    d = d.select("doc_id", F.coalesce("source", F.lit("")).alias("package"), F.coalesce("lang", F.lit("")).alias("lang"), parts.alias("s"))
    return _rows(d.select(
        F.col("doc_id").alias("fn_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), "package", "lang",
        F.concat(F.lit("/work/repo/"), "package", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("file_path"), F.transform("s", code).alias("token_seq"),
        F.transform("s", lambda x: F.regexp_extract(x, "^[^ ]+", 0)).alias("direct_imports"), F.transform("s", lambda x: F.regexp_extract(x, "[^ ]+$", 0)).alias("call_targets"),
    ))


def _bigrams(items: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(items) - 1, F.lit(1))), lambda i: F.concat_ws(">", F.get(items, i - 1), F.get(items, i)))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages: a token for each opening tag; tags are the imports, adjacent pairs the calls, the URL's language the package."""
    d = spark.read.parquet(f"{sf_dir}/pages.parquet").where("page_id is not null and html is not null")
    d = d.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.regexp_extract_all(F.lower("html"), F.lit("<([a-z][a-z0-9]*)"), F.lit(1)).alias("t"))
    return _rows(d.select(
        F.col("page_id").alias("fn_id"), F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("name"), F.regexp_extract("url", "^https?://[^/]+/([a-z]+)", 1).alias("package"),
        F.lit("html").alias("lang"), F.col("url").alias("file_path"), F.transform("t", code).alias("token_seq"), F.col("t").alias("direct_imports"), _bigrams(F.col("t")).alias("call_targets"),
    ))


def user_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events: a row for each user and week, with a token for each event in time order."""
    d = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null and ts is not null")
    d = d.groupBy("user_id", F.date_trunc("week", "ts").alias("week")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: F.coalesce(x["event_type"], F.lit(""))).alias("t"))
    day = F.date_format("week", "yyyyMMdd")
    return _rows(d.select(
        (F.col("user_id") * 100_000_000 + day.cast("long")).alias("fn_id"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("name"), day.alias("package"), F.lit("events").alias("lang"),
        F.concat(F.lit("/work/repo/"), F.col("user_id").cast("string")).alias("file_path"), F.transform("t", code).alias("token_seq"), F.col("t").alias("direct_imports"), _bigrams(F.col("t")).alias("call_targets"),
    ))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders: a token for each line item; suppliers are the imports, part brands the calls, the priority the package.

    (orderkey, linenumber) isn't unique, so line items are put in the order of all that the token depends on.
    """
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority")
    word = F.concat_ws("/", "l_returnflag", "l_linestatus", F.floor(F.col("l_quantity") / 5).cast("string"))
    d = li.join(part, F.col("l_partkey") == F.col("p_partkey"), "left").withColumn("word", word)
    g = d.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "word"))), lambda x: x["word"]).alias("t"), F.collect_set(F.col("l_suppkey").cast("string")).alias("direct_imports"), F.collect_set("p_brand").alias("call_targets"))
    g = g.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return _rows(g.select(
        F.col("o_orderkey").alias("fn_id"), F.concat(F.lit("order"), F.col("o_orderkey").cast("string")).alias("name"), F.coalesce("o_orderpriority", F.lit("")).alias("package"), F.lit("orders").alias("lang"),
        F.concat(F.lit("/work/repo/"), F.col("o_orderkey").cast("string")).alias("file_path"), F.transform("t", code).alias("token_seq"), "direct_imports", "call_targets",
    ))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a study over releases: each week is a release, and a user's events of one type in it a near miss.

    (tag, idx, package, func, file, cluster, score): the package is the event type, the user's group of 7 the file, and of 11 the cluster.
    """
    d = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null and ts is not null and event_type is not null")
    d = d.groupBy("user_id", "event_type", F.date_trunc("week", "ts").alias("week")).agg(F.avg("value").alias("score"))
    weeks = d.select("week").distinct()
    from pyspark.sql import Window as W

    weeks = weeks.withColumn("idx", F.row_number().over(W.orderBy("week")) - 1)  # a row for each week
    d = d.join(F.broadcast(weeks), "week")
    return d.select(
        F.concat(F.lit("v1."), F.col("idx").cast("string"), F.lit(".0")).alias("tag"), "idx", F.col("event_type").alias("package"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("func"),
        F.concat(F.lit("/work/repo/f"), (F.col("user_id") % 7).cast("string")).alias("file"), F.concat(F.lit("c"), (F.col("user_id") % 11).cast("string"), F.lit("_"), "event_type").alias("cluster"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def releases(snaps: DataFrame) -> DataFrame:
    """(tag, idx, ts, clusters, functions) of snapshots: each release's distinct clusters and near misses."""
    return snaps.groupBy("tag", "idx").agg(F.count_distinct("cluster").alias("clusters"), F.count("*").alias("functions")).withColumn("ts", F.col("idx").cast("long") * 604_800)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as findings of a review: a table of the shape that the matrix takes."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    band = F.floor(F.col("l_quantity") / 13)
    severity = F.when(band == 3, "High").when(band == 2, "Medium").when(band == 1, "Low").otherwise("Info")
    return li.where("l_discount is not null").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.when(F.col("l_linenumber") % 3 == 0, "C").when(F.col("l_linenumber") % 3 == 1, "A").otherwise("B").alias("pass"), F.concat(F.lit("CWE-"), (F.floor(F.col("l_discount") * 100) + 70).cast("string")).alias("cwe"), F.lit("").alias("cwe_name"),
        severity.alias("severity"), F.when(F.col("l_tax") > 0.05, "High").when(F.col("l_tax") > 0.02, "Medium").otherwise("Low").alias("confidence"),
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.concat(F.lit("c"), (F.col("l_suppkey") % 10).cast("string"))).alias("cluster_id"), F.col("l_linestatus").alias("package"),
        F.struct(F.when(F.col("l_returnflag") == "R", "refuted").when(F.col("l_returnflag") == "A", "partial").otherwise("confirmed").alias("status")).alias("verification"),
        F.when(F.col("l_suppkey") % 2 == 0, "unique").otherwise("assisted").alias("leverage"), F.when(F.col("l_suppkey") % 3 == 0, "novel").otherwise(F.lit(None)).alias("known_status"),
    )
