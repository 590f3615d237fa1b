"""Findings by cluster and weakness: the matrix, its counters, the report's gate, and rules from missing steps to weaknesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def row_key() -> Column:
    """A finding's row: its cluster, or its package, or '(unclustered)'."""
    filled = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    return F.coalesce(filled("cluster_id"), F.nullif("package", F.lit("")), F.lit("(unclustered)"))


def matrix_cells(findings: DataFrame) -> DataFrame:
    """(row, cwe, worst, findings): the number of findings in each cell and the severity of the worst."""
    rank = S.severity_rank(F.col("severity"))
    d = findings.groupBy(row_key().alias("row"), S.cwe_column(F.col("cwe")).alias("cwe")).agg(F.max(rank).alias("r"), F.count("*").alias("findings"))
    names = F.array(*[F.lit(x) for x in ("Info", "Low", "Medium", "High")])
    return d.select("row", "cwe", F.get(names, F.col("r")).alias("worst"), "findings")


def worst_cells(findings: DataFrame) -> DataFrame:
    """matrix_cells() with ``example``, what the worst finding of each cell says; of several, the least text."""
    have = {c.lower() for c in findings.columns}
    text = F.concat_ws(" ", *[F.col(c) for c in ("cwe", "function", "reason", "id") if c in have])
    d = findings.select(row_key().alias("row"), S.cwe_column(F.col("cwe")).alias("cwe"), F.struct((-S.severity_rank(F.col("severity"))).alias("r"), text.alias("t")).alias("x"))
    return matrix_cells(findings).join(d.groupBy("row", "cwe").agg(F.min("x").alias("x")), ["row", "cwe"]).select("row", "cwe", "worst", "findings", F.col("x.t").alias("example"))


def severity_matrix(findings: DataFrame) -> DataFrame:
    """A row for each cluster and a column for each weakness, by number: the worst severity's letter and the count, '·' if none.

    The columns are the weaknesses that occur, listed on the driver as in any pivot.
    """
    cells = matrix_cells(findings)
    number = F.coalesce(F.nullif(S.cwe_number(F.col("cwe")), F.lit("")).cast("long"), F.lit(10**9))
    columns = [r["cwe"] for r in cells.select("cwe").distinct().orderBy(number, "cwe").collect()]
    mark = F.when(F.col("worst") == "Info", "i").otherwise(F.substring("worst", 1, 1))
    d = cells.withColumn("cell", F.concat(mark, F.col("findings").cast("string"))).groupBy("row").pivot("cwe", columns).agg(F.first("cell"))
    return d.na.fill("·").orderBy("row")


def weaknesses(findings: DataFrame) -> DataFrame:
    """(cwe, label, band): each weakness with a name that its findings give it and the band of its most frequent pass."""
    c = findings.withColumn("cwe", S.cwe_column(F.col("cwe")))
    label = c.groupBy("cwe").agg(F.coalesce(F.min(F.nullif("cwe_name", F.lit(""))), F.first("cwe")).alias("label"))
    p = c.groupBy("cwe", F.coalesce("pass", F.lit("?")).alias("p")).agg(F.count("*").alias("n")).groupBy("cwe").agg(F.max_by("p", F.struct("n", "p")).alias("p"))
    return label.join(p, "cwe").select("cwe", "label", S.pass_band(F.col("p")).alias("band"))


def counters(findings: DataFrame) -> DataFrame:
    """(kind, value, findings): counts by severity, verification, leverage and known status; '?' where nothing is said."""
    have = {c.lower() for c in findings.columns}
    status = F.col("verification.status") if "verification" in have else F.lit(None).cast("string")
    kinds = {"severity": F.coalesce("severity", F.lit("Info")), "verification": F.coalesce(status, F.lit("?"))}
    for name in ("leverage", "known_status"):
        kinds[name] = F.coalesce(F.col(name), F.lit("?")) if name in have else F.lit("?")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()]))
    return findings.select(each.alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("findings"))


def report_gate(findings: DataFrame) -> DataFrame:
    """What may be reported: refuted findings go, partly confirmed ones are Medium at most."""
    status = F.coalesce(F.col("verification.status"), F.lit(""))
    severity = F.when((status == "partial") & (F.col("severity") == "High"), "Medium").otherwise(F.col("severity"))
    return findings.where(status != "refuted").withColumn("severity", severity)


def ranked(findings: DataFrame) -> DataFrame:
    """Findings by severity, then confidence, the worst and surest first."""
    sure = F.when(F.col("confidence") == "High", 3).when(F.col("confidence") == "Medium", 2).when(F.col("confidence") == "Low", 1).otherwise(0)
    return findings.orderBy(F.desc(S.severity_rank(F.col("severity"))), F.desc(sure), "id")


def rule_matches(deltas: DataFrame, rules: DataFrame) -> DataFrame:
    """(fn_id, cwe, step): missing steps that a rule (delta_regex, cwe) names. The rules are a table that people keep by hand."""
    step = deltas.select("fn_id", F.explode(F.concat("tokens_removed", "imports_removed", "calls_removed")).alias("step"))
    return step.join(rules, F.expr("step rlike delta_regex")).select("fn_id", "cwe", "step").distinct()


def advisory_matches(findings: DataFrame, advisories: DataFrame) -> DataFrame:
    """(id, advisory): findings with advisories of the same weakness."""
    a = advisories.dropDuplicates(["id"]).select(F.col("id").alias("advisory"), F.explode("cwes").alias("c")).select("advisory", S.cwe_column(F.col("c")).alias("cwe"))
    return findings.select("id", S.cwe_column(F.col("cwe")).alias("cwe")).join(a, "cwe").select("id", "advisory").distinct()
