import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from simlattice.functions import kernels as K
from simlattice.functions import scalars as S


def one(spark, *columns, **values):
    types = {"a": "array<int>", "b": "array<int>", "s": "array<string>", "t": "array<string>", "x": "string", "y": "string", "v": "double", "n": "long"}
    d = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {types[k]}" for k in values))
    return d.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_window_hashes(spark):
    h = lambda a: one(spark, S.window_hashes(F.col("a")), a=a)[0]
    assert h([1, 2, 3, 4, 5, 6, 7]) == [17426, 52012, 86598]
    assert [len(h(list(range(n)))) for n in (0, 2, 3, 4, 5, 7)] == [1, 1, 1, 1, 2, 3] and h([]) == [0] and h(None) is None
    a, b = h([1, 2, 3, 4, 5]), h([1, 2, 3, 99, 5])
    assert a[0] == b[0] and a[1] != b[1]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_sequence_similarity(spark):
    r = random.Random(1)
    for top in (5, 93, 60_000, 400_000):
        pairs = [([r.randrange(top) for _ in range(r.randrange(9))], [r.randrange(top) for _ in range(r.randrange(9))]) for _ in range(30)]
        pairs += [(a, a[1:]) for a, _ in pairs]
        d = spark.createDataFrame(pairs, "a array<int>, b array<int>")
        for x in d.select("*", S.seq_similarity(S.encode(F.col("a")), S.encode(F.col("b"))).alias("s")).collect():
            want = 1.0 if not x.a and not x.b else 1 - edit_distance(x.a, x.b) / max(len(x.a), len(x.b))
            assert x.s == pytest.approx(want)


def test_jaccard(spark):
    for s, t, want in (([], [], 0), (["a"], [], 0), (["a"], ["b"], 0), (["a", "b"], ["b", "a"], 1), (["a", "b"], ["b", "c"], 1 / 3)):
        assert one(spark, S.jaccard(F.col("s"), F.col("t")), s=s, t=t)[0] == pytest.approx(want)


def test_orphan_scores(spark):
    seq = S.seq_similarity(S.encode(F.col("a")), S.encode(F.col("b")))
    x = one(spark, seq, S.jaccard(F.col("s"), F.col("t")), S.arith_score(seq, F.lit(0.5), F.lit(0.5)), a=[1, 2, 3, 4], b=[1, 2, 3, 5], s=["fmt"], t=["fmt", "os"])
    assert x[0] == 0.75 and x[1] == 0.5 and x[2] == pytest.approx(0.583333, abs=1e-6)


def test_keys_and_names(spark):
    x = one(spark, S.seq_key(F.col("a")), S.seq_string(F.col("a")), S.shape_hash(S.seq_key(F.col("a"))), S.token_diff(F.col("a"), F.col("b")), a=[16, 7, 99], b=[7])
    assert x[0] == "16,7,99" and x[1] == "ASSIGN RETURN T99" and len(x[2]) == 16 and x[3] == ["ASSIGN", "tok99"]


def test_differences(spark):
    d = lambda a, b: one(spark, S.token_diff(F.col("a"), F.col("b")), S.token_diff(F.col("b"), F.col("a")), a=a, b=b)
    assert tuple(d([23], [23, 23])) == ([], ["CATCH"]) and tuple(d([23, 23], [23])) == (["CATCH"], []) and tuple(d([], [])) == ([], [])
    x = one(spark, S.list_diff(F.col("s"), F.col("t")), S.delta_text(F.col("s"), F.col("t")), S.delta_text(F.lit(None).cast("array<string>"), F.array().cast("array<string>")), s=["b", "a", "b"], t=["a"])
    assert x[0] == ["b", "b"] and x[1] == "+b  +a  +b  -a"


def test_texts(spark):
    x = one(spark, S.short_import(F.col("x")), S.short_path(F.col("x")), S.short_path(F.col("y")), S.relative_path(F.col("x")), S.relative_path(F.col("y")), S.browse_link(F.lit("https://h"), F.lit("v1"), F.col("x")), x="/w/repo/a/b/c.go", y="b/c.go")
    assert tuple(x) == ("c.go", "a/b/c.go", "b/c.go", "a/b/c.go", "b/c.go", "https://h/blob/v1/a/b/c.go")
    lines = [(tuple(one(spark, S.release_line(F.col("x")), x=t)[0])) for t in ("v1.22.3", "2.0", "latest")]
    assert lines == [(1, 22), (2, 0), (-1, -1)]
    x = one(spark, S.signed(F.lit(2.5)), S.signed(F.lit(-2.0)), S.signed(F.lit(0.0)), S.percent(F.lit(1), F.lit(3)), S.percent(F.lit(1), F.lit(0)), S.confidence_bar(F.lit(9.0)), S.confidence_bar(F.lit(4.0)), S.score_percent(F.lit(0.756)), n=1)
    assert tuple(x) == ("+2.5", "-2.0", "0.0", "33%", "0%", 100, 50, 75)
    x = one(spark, S.label_or_hash(F.lit(""), F.lit("h")), S.join_comma(F.col("s")), S.coherence_badge(F.lit(0.4)), S.score_badge(F.lit(0.75)), S.sensitivity(F.lit(0.03)), s=["a", "b"])
    assert tuple(x) == ("h", "a, b", "yellow", "green", "moderate")


def test_tiers_and_scores(spark):
    import math

    t = lambda v: one(spark, S.tier(F.col("v")), v=v)[0]
    assert [t(v) for v in (0.0, 0.049, 0.05, 0.119, 0.12, 1.0)] == ["high", "high", "medium", "medium", "low", "low"]
    c = lambda size, pk, tier, mean, i, k: one(spark, S.composite_score(F.lit(size), F.lit(pk), F.lit(tier), F.lit(mean), F.lit(i), F.lit(k)), n=1)[0]
    assert c(10, 1, "high", 0.9, 1.0, 1.0) == pytest.approx(math.log(10) * math.log(2) * 0.81)
    assert c(1, 1, "high", 1.0, 1.0, 1.0) == c(0, 1, "high", 1.0, 1.0, 1.0) == c(5, 1, "low", 0.0, 1.0, 1.0) == c(5, 1, "low", 1.0, 0.0, 0.0) == 0
    bar = lambda n, m, s, k=5.0: one(spark, S.admission_bar(0.75, F.lit(n), F.lit(m), F.lit(s), shrink=k), n=1)[0]
    assert bar(5.0, 0.95, 0.0) == pytest.approx(0.85) and bar(5.0, 0.5, 0.0) == 0.75 and bar(5.0, 0.95, 0.0, 0.0) == pytest.approx(0.95)


def test_commits(spark):
    kinds = lambda x: tuple(one(spark, *[S.commit_is(k, F.col("x")) for k in ("fix", "refactor", "feature")], x=x))
    assert kinds("Fixes a RACE") == (True, False, False) and kinds("refactoring") == (False, True, False) and kinds("Add new flag") == (False, False, True)
    assert kinds("prefix") == (False, False, False) and kinds("address") == (False, False, False) and kinds("CVE-2024") == (True, False, False)


def test_weaknesses(spark):
    f = lambda x: one(spark, S.cwe_column(F.col("x")), x=x)[0]
    assert [f(x) for x in ("CWE-79", "79", "", None, "other")] == ["CWE-79", "CWE-79", "CWE-?", "CWE-?", "other"]


def test_aliases_and_calls(spark):
    d = spark.createDataFrame([([("", "a/b"), ("z", "c/d"), ("_", "e"), (".", "f"), (None, "fmt")],)], "i array<struct<alias:string,path:string>>")
    assert d.select(S.alias_map(F.col("i"))).first()[0] == {"b": "a/b", "z": "c/d", "fmt": "fmt"}
    c = lambda sel, r: one(spark, S.classify_call(F.lit(sel), F.lit(r), F.col("s")), s=["fmt"])[0]
    assert [c(False, ""), c(True, "fmt"), c(True, "w")] == [14, 17, 18]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_lcs(a, b):
    def table(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
        return d

    got, d = K.lcs(a, b), table(a, b)
    assert len(got) == d[-1][-1] and len(K.lcs(got, a)) == len(got) == len(K.lcs(got, b))
    i, j, want = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            want.append(a[i - 1])
            i, j = i - 1, j - 1
        elif d[i - 1][j] >= d[i][j - 1]:
            i -= 1
        else:
            j -= 1
    assert got == want[::-1]
    assert K.fold_lcs([a, b, a, b]) == K.fold_lcs([a, b]) and K.fold_lcs([]) == []


def test_source_text():
    src = 'x := "a//b" // c\n/* d\n e */ y := `r"` + \'\\\'\''
    out = K.strip_source(src)
    assert len(out) == len(src) and out.count("\n") == src.count("\n") and not set("abcdr") & set(out)
    assert K.normal_form("a  // x\n b") == "a b"
    raw, stripped = K.find_function('// func f() {}\nfunc (r *T) f(a int) { s := "}"; if a { g() } }\nfunc g() {}', "f")
    assert raw.startswith("func (r *T) f") and raw.endswith("} }") and '"}"' in raw and '"}"' not in stripped
    assert K.find_function("func f() {", "f") is None
    assert K.coarse_tokens("if a == b { x := f(y); z = p.q(1) } return") == ["IF", "ASSIGN", "CALL", "ASSIGN", "CALL_Q", "RETURN"]


def test_source_columns(spark):
    d = spark.createDataFrame([("func f() { return 1 }", "f", "func f() { /* c */ return  1 }"), (None, "f", None)], "a string, n string, b string")
    r = d.select(K.find_function_udf("a", "n"), K.normal_form_udf("b"), K.ratio(K.normal_form_udf("a"), K.normal_form_udf("b")), K.coarse_tokens_udf("a")).collect()
    assert r[0][0] == "func f() { return 1 }" and r[0][1] == r[0][0] and r[0][2] == 1.0 and r[0][3] == ["CALL", "RETURN"] and tuple(r[1]) == (None, None, None, None)
    from pyspark.sql.types import ArrayType, IntegerType  # noqa: F401

    assert spark.createDataFrame([([1, 2, 3], [2, 3])], "a array<int>, b array<int>").select(K.lcs_udf("a", "b")).first()[0] == [2, 3]
