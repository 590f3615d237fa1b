"""Source trees as function rows, and the records that parsers of other languages leave."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..operators.cluster import TEST_IMPORTS
from ..schema import FUNCTIONS, PARAMS, RETURNS, complete

LANGUAGES = {".go": "golang", ".java": "java"}
SKIPPED = r"(\.pb\.go|\.pb\.gw\.go|_test\.go|\.ignore\.go|invalid\.go)$|^(mock_|zz_generated)"
_PARSED = T.StructType([f for f in FUNCTIONS.fields if f.name not in ("fn_id", "token_seq_hash")])


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def wanted(path: Column) -> Column:
    """Files of an accepted language that are neither generated, nor tests, nor under a folder named vendor."""
    return path.rlike(r"\.(go|java)$") & ~base_name(path).rlike(SKIPPED) & ~F.lower(path).rlike("/vendor/")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, pkg_dir, lang, content) of all wanted files under ``root``; a root that isn't there is an error.

    Names are filtered on the listing, so files that aren't wanted are never read.
    """
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{go,java}").load(root)
    d = d.where(wanted(F.col("path")))
    lang = F.when(F.col("path").endswith(".go"), LANGUAGES[".go"]).otherwise(LANGUAGES[".java"])
    folder = F.regexp_replace(F.regexp_replace("path", "^file:", ""), "/[^/]*$", "")
    relative = F.expr(f"substr(folder, length({_quoted(root.rstrip('/'))}) + 2)")
    d = d.select(F.regexp_replace("path", "^file:", "").alias("path"), base_name(F.col("path")).alias("name"), folder.alias("folder"), lang.alias("lang"), F.decode("content", "UTF-8").alias("content"))
    return d.select("path", "name", F.when(relative == "", ".").otherwise(relative).alias("pkg_dir"), "lang", "content")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def packages(files: DataFrame) -> DataFrame:
    """(pkg_dir, files): the files of each folder."""
    return files.groupBy("pkg_dir").agg(F.array_sort(F.collect_list(F.struct("name", "path", "lang"))).alias("files"))


def parse_go(files: DataFrame) -> DataFrame:
    """Function rows of Go files (path, content). A file with a syntax error, or null content, gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .golang import SyntaxProblem, parse_file

        for batch in batches:
            rows: list[dict] = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += parse_file(content or "", path or "")
                except (SyntaxProblem, RecursionError):
                    continue
            if rows:
                yield pd.DataFrame(rows, columns=_PARSED.names)

    return with_ids(files.where("content is not null").select("path", "content").mapInPandas(run, _PARSED))


def with_ids(rows: DataFrame) -> DataFrame:
    """complete() function rows whose fn_id is a hash of language, path, line, name and receiver: the same in every run."""
    return complete(rows).withColumn("fn_id", F.xxhash64("lang", "file_path", "start_line", "name", "receiver"))


_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()
RECORD = T.StructType(
    [
        T.StructField("file", _S), T.StructField("package_name", _S), T.StructField("imports", T.ArrayType(_S)),
        T.StructField("functions", T.ArrayType(T.StructType([
            *[T.StructField(x, _S) for x in ("name", "package_name", "file_name", "file_path")], *[T.StructField(x, _I) for x in ("start_line", "end_line", "line_count")],
            *[T.StructField(x, _B) for x in ("is_method", "is_exported")], T.StructField("receiver", _S), T.StructField("params", PARAMS), T.StructField("returns", RETURNS),
            T.StructField("token_seq", T.ArrayType(_I)), T.StructField("token_seq_hash", T.ArrayType(T.LongType())), *[T.StructField(x, T.ArrayType(_S)) for x in ("call_targets", "direct_imports", "imports")],
            *[T.StructField(x, _B) for x in ("generated_code", "test_code", "is_constructor")], T.StructField("body", _S),
        ]))),
    ]
)


def read_records(spark: SparkSession, path: str, lang: str = "java") -> DataFrame:
    """Function rows of another parser's JSON files, one object a file. Tests and generated code are left out, window hashes made
    anew, and features, which such parsers don't give, are zero. A file that isn't such an object gives nothing."""
    d = spark.read.schema(RECORD).option("multiLine", "true").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").json(path)
    f = d.select(F.explode("functions").alias("f")).select("f.*").where("not coalesce(test_code, false) and not coalesce(generated_code, false)")
    return with_ids(f.drop("token_seq_hash").withColumnRenamed("package_name", "package").withColumn("lang", F.lit(lang)))


def read_tree(spark: SparkSession, root: str, records: str | None = None) -> DataFrame:
    """Function rows of all Go files under ``root`` and, if given, of the records of a Java parser."""
    go = parse_go(scan(spark, root).where(F.col("lang") == "golang"))
    return go if records is None else go.unionByName(read_records(spark, records))


def trailing_returns(tokens: Column, return_count: Column) -> Column:
    """Tokens of a body with a RETURN for each value that the function returns."""
    from ..schema import CODE

    return F.concat(tokens, F.array_repeat(F.lit(CODE["RETURN"]), return_count))


def control_flow(tokens: Column) -> dict[str, Column]:
    """Counters of the token-backed statements; RETURN counts the returned values as well."""
    return {n: S.count_token(tokens, n.upper()) for n in ("if", "for", "range", "switch", "select", "return", "defer", "go", "send", "continue", "break", "goto")}


def is_test(imports: Column) -> Column:
    return F.arrays_overlap(imports, F.array(*[F.lit(x) for x in TEST_IMPORTS]))


def is_generated(comments: Column) -> Column:
    return F.exists(comments, lambda c: c.startswith("// Code generated"))
