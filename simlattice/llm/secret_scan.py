"""Secret scans weighed by corpus-wide ownership."""

from __future__ import annotations

from functools import partial, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cut

#: (kind, pattern): the first group is the secret. The patterns mean the same to Java's and to RE2-like engines.
DETECTORS = (
    ("assigned", r"(?i)(?:token|secret|passw(?:or)?d|passphrase|api[_.-]?key|access[_.-]?key)[A-Za-z0-9_.-]{0,100}[\\\"']{0,2}[ \t]*[=:]{1,2}>?[ \t]*[\\\"']{0,2}([A-Za-z0-9_/+.-]{16,}={0,2})(?:[\\\"'\s,;)}&<\]]|$)"),
    ("aws_key", r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b"),
    ("github", r"\b(gh[pousr]_[A-Za-z0-9]{36,})\b"),
    ("slack", r"\b(xox[abprs]-[A-Za-z0-9-]{10,})\b"),
    ("google", r"\b(AIza[0-9A-Za-z_-]{35})\b"),
    ("stripe", r"\b([sr]k_live_[0-9A-Za-z]{16,})\b"),
    ("jwt", r"\b(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"),
    ("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----\s+([A-Za-z0-9+/=\s]{32,})-----END"),
)
#: A substring that every match of the detector has; it spares most texts the pattern. Those of ANY_CASE are looked for in the lower-cased text.
HINTS = {"assigned": ("token", "secret", "passw", "passphrase", *[f"{x}{y}key" for x in ("api", "access") for y in ("", "_", ".", "-")]), "aws_key": ("AKIA", "ASIA"), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "slack": ("xox",), "google": ("AIza",), "stripe": ("k_live_",), "jwt": ("eyJ",), "private_key": ("PRIVATE KEY",)}
ANY_CASE = {"assigned"}


def _finding(kind: str, secret: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), secret.alias("secret"))


def candidates(docs: DataFrame, *, doc_id: str, text: str, repository: Column, owner: Column) -> DataFrame:
    """(doc_id, repository, owner, kind, secret): every match of every detector in the whole texts.

    The hints are columns of their own: generated code looks for them, and lowers a text once for all of them.
    """
    t, found = F.col("t"), []
    d = docs.select(col(doc_id).alias("doc_id"), repository.alias("repository"), owner.alias("owner"), col(text).alias("t"))
    d = d.withColumn("low", F.lower("t"))
    hinted = []
    for kind, _ in DETECTORS:
        some = F.lit(False)
        for h in HINTS[kind]:
            some = some | F.col("low" if kind in ANY_CASE else "t").contains(h)
        hinted.append(some.alias(f"has_{kind}"))
    d = d.select("doc_id", "repository", "owner", "t", *hinted).where(reduce(or_, [F.col(f"has_{kind}") for kind, _ in DETECTORS]))
    for kind, pattern in DETECTORS:
        hits = F.when(F.col(f"has_{kind}"), F.regexp_extract_all(t, F.lit(pattern), F.lit(1)))
        found.append(F.transform(F.coalesce(hits, F.array().cast("array<string>")), partial(_finding, kind)))
    return d.select("doc_id", "repository", "owner", F.explode(F.concat(*found)).alias("x")).select("doc_id", "repository", "owner", "x.kind", "x.secret")


def scan(docs: DataFrame, *, copied_owners: int = 3, min_distinct: int = 8, doc_id: str = "doc_id", text: str = "text", repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """(doc_id, kind, secret_hash, matches, docs, repositories, owners, verdict): a row for each document and secret.

    docs, repositories and owners count where the same secret occurs in the whole corpus. 'placeholder': fewer than
    ``min_distinct`` different characters, or a telling word in it. 'example': ``copied_owners`` owners or more have it.
    'shared': two owners up to that. 'live': one owner's alone. Secrets leave only as SHA-256.

    By default a document's owner is its source, and its repository the source's part in its language. Null owner or
    repository: '' stands for it. Null or empty text: no match. Null doc_id: a document of its own that all such rows share.
    Repeated rows add to ``matches`` only. Empty table: no row. Other columns of ``docs`` aren't read.
    """
    repository = F.concat_ws("/", F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("lang"), F.lit(""))) if repository is None else F.coalesce(repository, F.lit(""))
    owner = F.coalesce(F.col("source") if owner is None else owner, F.lit(""))
    c = candidates(docs, doc_id=doc_id, text=text, repository=repository, owner=owner)
    c = c.withColumn("secret_hash", F.sha2("secret", 256))
    weak = (F.size(F.array_distinct(F.split("secret", ""))) < min_distinct) | F.col("secret").rlike("(?i)example|changeme|placeholder|dummy|your_|xxxx")
    # kept, since four aggregates follow: the texts are scanned once
    per = cut(c.groupBy("doc_id", "kind", "secret_hash", "repository", "owner").agg(F.count("*").alias("matches"), F.first(weak).alias("weak")))
    # distinct counts by steps of plain grouping: a secret with very many documents is no single task's work
    d = per.groupBy("kind", "secret_hash", "doc_id").agg(F.lit(1).alias("one")).groupBy("kind", "secret_hash").agg(F.count("*").alias("docs"))
    r = per.groupBy("kind", "secret_hash", "repository").agg(F.lit(1).alias("one")).groupBy("kind", "secret_hash").agg(F.count("*").alias("repositories"))
    o = per.groupBy("kind", "secret_hash", "owner").agg(F.lit(1).alias("one")).groupBy("kind", "secret_hash").agg(F.count("*").alias("owners"))
    rows = per.groupBy("doc_id", "kind", "secret_hash").agg(F.sum("matches").alias("matches"), F.max("weak").alias("weak"))
    key = ["kind", "secret_hash"]
    verdict = F.when(F.col("weak"), "placeholder").when(F.col("owners") >= copied_owners, "example").when(F.col("owners") > 1, "shared").otherwise("live")
    return rows.join(d.join(r, key).join(o, key), key).select("doc_id", "kind", "secret_hash", "matches", "docs", "repositories", "owners", verdict.alias("verdict"))
