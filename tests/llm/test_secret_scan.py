import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from simlattice.llm import secret_scan as S

KEY = "AKIA" + "Q3XZ7T9LMN2PV5RS"


def test_whole_table_against_python(spark, sf):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hits = defaultdict(int)
    for r in d.collect():
        for kind, pattern in S.DETECTORS:
            for s in re.findall(pattern, r["text"] or ""):
                hits[(r["doc_id"], kind, hashlib.sha256(s.encode()).hexdigest())] += 1
    assert {(r["doc_id"], r["kind"], r["secret_hash"]): r["matches"] for r in S.scan(d).collect()} == dict(hits) and hits


def test_ownership_decides(spark):
    shared, copied = "AKIA" + "B4YD8KQWERTYUI12", "AKIA" + "C5ZE9MNBVCXZAS34"
    rows = [(1, f"id {KEY} here", "en", "o1"), (2, f"{KEY} again {KEY}", "de", "o1"), (3, shared, "en", "o1"), (4, shared, "en", "o2"), *[(10 + i, copied, "en", f"o{i}") for i in range(4)], (20, "AKIA" + "A" * 16, "en", "o1"), (21, 'password = "example0123456789xyz"', "en", "o9")]
    got = {(r["doc_id"]): r for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[1]["verdict"] == got[2]["verdict"] == "live" and got[2]["matches"] == 2 and got[1]["docs"] == 2 and got[1]["repositories"] == 2 and got[1]["owners"] == 1
    assert got[3]["verdict"] == "shared" and got[10]["verdict"] == "example" and got[20]["verdict"] == got[21]["verdict"] == "placeholder"
    assert KEY not in str(got.values())


def test_detectors():
    hit = {"github": "ghp_" + "a1B2" * 9, "slack": "xoxb-1234567890-abc", "google": "AIza" + "Sy" * 17 + "x", "stripe": "sk_live_" + "a1b2c3d4" * 2, "jwt": "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.c2lnbmF0dXJl", "assigned": 'api_key: "abcdEFGH12345678"'}
    for kind, pattern in S.DETECTORS:
        if kind in hit:
            assert re.search(pattern, f"x {hit[kind]} y"), kind
            assert any(h in hit[kind] for h in S.HINTS[kind]), kind
        assert not re.search(pattern, "an ordinary sentence about tokens, keys and passwords")


def test_cases(spark, docs, empty, clashing):
    assert S.scan(docs).count() == 0 and S.scan(empty).count() == 0 and S.scan(clashing).count() == 0
    rows = [(None, KEY, None, None), (None, KEY, None, None), (5, KEY + " " + "x " * 200_000 + KEY, None, None), (5, KEY, None, None)]
    got = {r["doc_id"]: r for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[5]["matches"] == 3 and got[None]["matches"] == 2 and got[5]["docs"] == 2 and got[5]["owners"] == 1
    by_column = S.scan(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), owner=F.col("doc_id").cast("string"), repository=F.lit("r")).collect()
    assert {r["owners"] for r in by_column} == {2} and {r["repositories"] for r in by_column} == {1}


def test_assignments_in_other_forms(spark):
    v = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    forms = [f'access_token = "{v}"', f'client_secret="{v}"', f"db_password: '{v}'", f'API_TOKEN="{v}"', f'SECRET_KEY = "{v}"', f'PASSWORD="{v}"', f'{{"token": "{v}"}}', f"token={v}", f"export AWS_SECRET_ACCESS_KEY={v}\n", f'{{\\"apiKey\\": \\"{v}\\"}}', f"?token={v}&x=1"]
    more = {f'token = "{v}=="': v + "==", f'secret = "{v * 9}"': v * 9, "xoxb-" + v * 9: "xoxb-" + v * 9, "sk_live_" + v * 9: "sk_live_" + v * 9, "ghp_" + v * 9: "ghp_" + v * 9}
    want = {**dict.fromkeys(forms, v), **more}
    rows = [(i, f"x {t} y" if not t.endswith("\n") else t, "en", "o") for i, t in enumerate(want)]
    got = {r["doc_id"]: r["secret_hash"] for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got == {i: hashlib.sha256(s.encode()).hexdigest() for i, s in enumerate(want.values())}
