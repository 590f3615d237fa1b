"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, classifier, exact_dedup, html_extract, mixing, near_dedup, packing, quality, secret_scan, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return quality.judge(d).select("doc_id", "lang", "n_chars_seen", "n_words", "char_distance", "word_distance", "keep", "reason")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(_table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.reconstruct(chat.as_log(_table(spark, sf_dir, "conversations"), revised=True))


def op7_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return classifier.classify(d, classifier.train(d, _table(spark, sf_dir, "labels")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write(_table(spark, sf_dir, "pages"), warc.fresh_folder(spark), shard_bytes=1 << 26, file_bytes=1 << 23)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_mixing, op2_quality, op3_exact_dedup, op4_secrets, op5_near_dedup, op6_chat, op7_classifier, op8_warc, op9_html, op10_packing, pipeline)
    return {f.__name__: f for f in named}


TOKEN = "[^ \\t\\n\\r]+"

#: The schedule in SQL: running token counts, blocks, weights, and the slots up to the one at which every block is placed.
OP1 = f"""
WITH d AS (SELECT coalesce(source, '') AS source, doc_id, md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), '/17')) AS k,
                  len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) AS n FROM documents),
st AS (SELECT source, doc_id, n, CAST(sum(n) OVER (PARTITION BY source ORDER BY k, doc_id, n ROWS UNBOUNDED PRECEDING) AS BIGINT) - n AS st FROM d WHERE n > 0),
p AS (SELECT source, doc_id, n, st, unnest(range(st // 2048, (st + n - 1) // 2048 + 1)) AS block FROM st),
pieces AS (SELECT source, block, doc_id, greatest(block * 2048 - st, 0) AS doc_from, least((block + 1) * 2048 - st, n) AS doc_to FROM p),
t AS (SELECT source, sum(doc_to - doc_from) AS t, max(block) + 1 AS n FROM pieces GROUP BY source),
w AS (SELECT source, n, round(pow(t / sum(t) OVER (), 0.8), 12) AS w FROM t),
e AS (SELECT source, n, row_number() OVER (ORDER BY source) AS i, w / sum(w) OVER () AS share, sum(w) OVER (ORDER BY source) / sum(w) OVER () AS hi, count(*) OVER () AS many FROM w),
f AS (SELECT source, n, share, CASE WHEN i = 1 THEN 0 ELSE lag(hi) OVER (ORDER BY i) END AS lo, CASE WHEN i = many THEN 1 ELSE hi END AS hi FROM e),
s AS (SELECT unnest(range(CAST((SELECT 2 * max(n / share) + 1000 FROM f) AS BIGINT))) AS slot),
u AS (SELECT slot, ((slot + 1) * 0.6180339887498949::DOUBLE) % 1::DOUBLE AS u FROM s),
r AS (SELECT slot, source, n, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS r FROM u JOIN f ON u >= lo AND u < hi),
kept AS (SELECT slot, source, r // n AS epoch, r % n AS block FROM r WHERE slot <= (SELECT max(slot) FROM r WHERE r = n - 1))
SELECT slot, source, epoch, block, doc_id, doc_from, doc_to FROM kept JOIN pieces USING (source, block)
"""

OP3 = """
SELECT doc_id, first AS duplicate_of FROM (
    SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS i
    FROM documents WHERE text IS NOT NULL AND text <> '') WHERE i > 1
"""


def _op4() -> str:
    found = " UNION ALL ".join(
        f"SELECT doc_id, repository, owner, '{kind}' AS kind, unnest(regexp_extract_all(text, '{pattern.replace(chr(39), chr(39) * 2)}', 1)) AS secret FROM d" for kind, pattern in secret_scan.DETECTORS
    )
    return f"""
WITH d AS (SELECT doc_id, text, coalesce(source, '') AS owner, concat(coalesce(source, ''), '/', coalesce(lang, '')) AS repository FROM documents),
c AS ({found}),
w AS (SELECT *, sha256(secret) AS secret_hash, len(list_distinct(string_split(secret, ''))) < 8 OR regexp_matches(secret, '(?i)example|changeme|placeholder|dummy|your_|xxxx') AS weak FROM c),
g AS (SELECT kind, secret_hash, count(DISTINCT doc_id) AS docs, count(DISTINCT repository) AS repositories, count(DISTINCT owner) AS owners FROM w GROUP BY ALL),
r AS (SELECT doc_id, kind, secret_hash, count(*) AS matches, bool_or(weak) AS weak FROM w GROUP BY ALL)
SELECT doc_id, kind, secret_hash, matches, docs, repositories, owners,
       CASE WHEN weak THEN 'placeholder' WHEN owners >= 3 THEN 'example' WHEN owners > 1 THEN 'shared' ELSE 'live' END AS verdict
FROM r JOIN g USING (kind, secret_hash)
"""


def _safe(text: str) -> str:
    return f"replace(replace({text}, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>')"


#: What the log of drafts, edits, regenerations and deletions must fold to: the table's own turns.
OP6 = f"""
WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations)
SELECT conv_id, count(*) AS n_messages, arg_max(role, (turn, role, text)) AS last_role,
       string_agg('<|im_start|>' || {_safe("regexp_replace(role, '[\\n\\r:]', ' ', 'g')")} || chr(10) || {_safe('text')} || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
FROM t GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {"op1_mixing": OP1, "op3_exact_dedup": OP3, "op4_secrets": _op4(), "op6_chat": OP6}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
