import random

import pytest
from pyspark.sql import functions as F

from simlattice.operators import calibrate as K
from simlattice.operators import longitudinal as L
from simlattice.operators import security as X
from simlattice.plans.analysis import Analysis
from simlattice.schema import Config, complete

SCHEMA = "fn_id long, name string, package string, file_path string, start_line int, token_seq array<int>, direct_imports array<string>, call_targets array<string>"
SNAP = "tag string, idx long, package string, func string, file string, cluster string, score double"


def test_knee(spark):
    k = lambda *s: [tuple(r) for r in K.knee(spark.createDataFrame([(0.9 - 0.05 * i, float(x)) for i, x in enumerate(s)], "threshold double, bootstrap_stability double")).collect()]
    assert k(0.9, 0.88, 0.5, 0.45)[0] == (pytest.approx(0.8), pytest.approx(0.38)) and k(0.9, 0.5) == [] and k(0.9, 0.88, 0.86) == [] and k(0.5, 0.6, 0.9) == []


def test_samples(spark):
    fns = spark.range(50).withColumnRenamed("id", "fn_id")
    s = K.subsamples(fns, rounds=4)
    assert {r["boot"]: r["count"] for r in s.groupBy("boot").count().collect()} == dict.fromkeys(range(4), 40)
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, K.subsamples(fns.repartition(7), rounds=4).collect())) and s.distinct().count() == 160
    assert K.subsamples(spark.range(2).withColumnRenamed("id", "fn_id"), rounds=1).count() == 2 and K.grid(spark).count() == 180


@pytest.fixture(scope="module")
def corpus(spark):
    r, rows = random.Random(4), []
    for i in range(90):
        base = [[0, 1, 14, 7, 7, 16, 2], [3, 4, 18, 16, 7, 4, 18], [20, 16, 20, 16, 17, 7, 0]][i % 3] if i < 24 else [r.randrange(22) for _ in range(8)]
        seq = [t if r.random() > 0.05 else r.randrange(22) for t in base]
        rows.append((i, f"f{i}", "p", "a", i, seq, [f"i{i % 3}", "z"], r.sample([f"c{i % 3}{k}" for k in range(4)], 3)))
    return complete(spark.createDataFrame(rows, SCHEMA))


def test_calibration_is_one_run_after_the_other(spark, corpus):
    """All thresholds and resamples in one job, against a separate analysis for each."""
    cfg, rounds, thresholds = Config(primitive_threshold=0.5, max_bucket=12), 3, (0.7, 0.8)
    got = {r["threshold"]: r for r in K.calibrate(corpus, cfg, thresholds, rounds).collect()}
    samples = {}
    for r in K.subsamples(corpus, rounds).collect():
        samples.setdefault(r["boot"], []).append(r["fn_id"])

    def clusters(fns, t):
        out = {}
        for r in Analysis(fns, Config(primitive_threshold=0.5, max_bucket=12, identify_threshold=t)).members.collect():
            out.setdefault(r["cluster_id"], set()).add(r["fn_id"])
        return list(out.values())

    for t in thresholds:
        full, hits = clusters(corpus, t), []
        for ids in samples.values():
            boot = clusters(corpus.where(F.col("fn_id").isin(ids)), t)
            hits.append([any(len(a & b) / len(a | b) > 0.5 for b in boot) for a in full])
        stable = [sum(h[i] for h in hits) >= int(rounds * 0.7) for i in range(len(full))]
        sizes = sorted(map(len, full))
        r = got[t]
        assert (r["num_clusters"], r["num_clustered"], r["max_cluster_size"], r["median_cluster_size"]) == (len(full), sum(sizes), sizes[-1], sizes[len(sizes) // 2])
        assert r["bootstrap_stability"] == pytest.approx(sum(stable) / len(full)) and r["stable_clusters"] == sum(stable) and r["coverage"] == pytest.approx(sum(sizes) / 90)
    lines = [r[0] for r in K.csv_rows(K.calibrate(corpus, cfg, thresholds, rounds)).collect()]
    assert len(lines) == 2 and lines[0].startswith("0.80,") and lines[0].count(",") == 12


def test_releases(spark):
    rel = spark.createDataFrame([("v1.10.0", 5), ("v1.9.3", 9), ("v1.9.10", 1), ("nightly", 2)], "tag string, ts long")
    assert [r["tag"] for r in L.release_order(rel).orderBy("idx").collect()] == ["v1.9.3", "v1.9.10", "v1.10.0"]
    assert [r["tag"] for r in L.release_order(rel, 2).orderBy("idx").collect()] == ["v1.9.10", "v1.10.0"]
    assert [r["tag"] for r in L.release_order(rel.where("tag = 'nightly'")).collect()] == ["nightly"]
    rel = spark.createDataFrame([("v3.5.0", 10), ("v3.5.1", 50), ("v3.6.0", 30), ("v3.7.0", 60), ("v3.7.1", 70)], "tag string, ts long")
    chains = {}
    for r in L.chains(rel).orderBy("chain", "pos").collect():
        chains.setdefault(r["chain"], []).append(r["tag"])
    assert list(chains.values()) == [["v3.5.0", "v3.5.1"], ["v3.6.0", "v3.7.0", "v3.7.1"]]


def test_tracking_and_resolutions(spark):
    rows = [("a", 0, "p", "f", "x", "c1", 0.8), ("b", 1, "p", "f", "y", "c2", 0.6), ("a", 0, "p", "g", "x", "c1", 0.5), ("a", 0, "p", "h", "z", "c9", 0.5), ("b", 1, "q", "k", "x", "c1", 0.5), ("a", 0, "p", "m", "y", "c8", 0.5), ("c", 2, "q", "k", "x", "", 0.1)]
    s = spark.createDataFrame(rows, SNAP)
    t = {r["func"]: r for r in L.outlier_tracking(s).collect()}
    assert t["f"]["file"] == "y" and t["f"]["release_list"] == "a;b" and t["f"]["top_cluster"] == "c1" and t["f"]["mean_score"] == pytest.approx(0.7) and (t["k"]["first_seen"], t["k"]["last_seen"]) == ("b", "c")
    rel = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "tag string, idx long")
    res = {(r["func"], r["outlier_in"]): r["resolution"] for r in L.resolutions(s, rel).collect()}
    assert res == {("g", "a"): "rejoined_cluster", ("h", "a"): "deleted_or_moved", ("m", "a"): "fixed_or_refactored", ("f", "b"): "deleted_or_moved"}
    assert L.resolution_counts(L.resolutions(s, rel)).first()["verdict"] == "moderate" and L.transitions(L.resolutions(s, rel)).count() == 2
    none = spark.createDataFrame([], SNAP)
    assert L.outlier_tracking(none).count() == L.resolutions(none, rel).count() == 0 and L.resolution_counts(L.resolutions(none, rel)).first()["total"] == 0
    p = L.outlier_persistence(L.outlier_tracking(s), 3).first()
    assert (p["total_unique"], p["persistent"], p["brief"], p["universal"]) == (5, 2, 3, 0)


def test_trends(spark):
    d = spark.createDataFrame([(0, "1.0", 10, 100), (1, "?", 20, 100), (2, "1.1", 30, 100)], "idx long, t string, clusters long, functions long")
    r = L.threshold_drift(d, ("t",)).first()
    assert r["n"] == 2 and r["drift"] == pytest.approx(0.1) and r["max_jump"] == pytest.approx(0.1) and r["verdict"] == "moderate"
    g = L.growth(d).first()
    assert (g["cluster_slope"], g["function_slope"], g["verdict"]) == (10, 0, "rising") and L.growth(d.limit(0)).first()["cluster_slope"] == 0


def test_verdicts(spark):
    cols = "found boolean, unchanged boolean, moved boolean, diff_ratio double, movement double, fix int, refactor int, feature int"
    rows = [(False,) + (None,) * 7, (True, True, True, 0.0, None, 1, 0, 0), (True, False, True, 0.05, 0.5, 1, 0, 0), (True, False, False, 0.5, 0.06, 1, 9, 9), (True, False, False, 0.5, None, 2, 2, 1), (True, False, False, 0.5, 0.0, 1, 0, 2), (True, None, None, None, None, None, 1, None), (True,) + (None,) * 7]
    got = [r["verdict"] for r in L.verdicts(spark.createDataFrame(rows, cols)).collect()]
    assert got == ["DELETED", "ARTEFACT", "MOVED", "FIXED_TOWARD_CONVENTION", "LIKELY_FIX", "REQUIREMENT_CHANGE", "REFACTOR", "AMBIGUOUS"]
    d = spark.createDataFrame([("f", "func f() { a() }", "package p\nfunc f() { // c\n a() }", "CALL"), ("f", "func f() { a() }", None, ""), ("f", "func f() { a() }", "func f() { if x { a() } }", "IF CALL")], "func string, old_body string, new_source string, common_shape string")
    r = L.code_facts(d).collect()
    assert (r[0]["found"], r[0]["unchanged"], r[0]["diff_ratio"]) == (True, True, 0.0) and not r[1]["found"] and not r[2]["unchanged"] and r[2]["movement"] > 0
    assert {x["verdict"]: x["class"] for x in L.verdict_counts(L.verdicts(spark.createDataFrame(rows, cols))).collect()}["ARTEFACT"] == "artefact"


def test_matrix(spark):
    f = "id string, pass string, cwe string, cwe_name string, severity string, confidence string, cluster_id string, package string, verification struct<status:string>"
    rows = [("1", "A", "CWE-89", "SQL", "High", "Low", "c1", "p", ("partial",)), ("2", "B", "79", "", "Low", "High", "c1", "p", ("refuted",)), ("3", "A", "CWE-79", "XSS", "Medium", None, " ", "p", None), ("4", None, None, None, None, None, None, None, None)]
    d = spark.createDataFrame(rows, f)
    m = X.severity_matrix(d)
    assert m.columns == ["row", "CWE-79", "CWE-89", "CWE-?"] and {tuple(r) for r in m.collect()} == {("(unclustered)", "·", "·", "i1"), ("c1", "L1", "H1", "·"), ("p", "M1", "·", "·")}
    assert {r["id"]: r["severity"] for r in X.report_gate(d).collect()} == {"1": "Medium", "3": "Medium", "4": None}
    assert [r["id"] for r in X.ranked(d).collect()] == ["1", "3", "2", "4"]
    assert {(r["kind"], r["value"]): r["findings"] for r in X.counters(d).collect()}[("verification", "?")] == 2
    assert {r["cwe"]: (r["label"], r["band"]) for r in X.weaknesses(d).collect()}["CWE-79"][0] == "XSS"
    rules = spark.createDataFrame([("^close", "CWE-404")], "delta_regex string, cwe string")
    delta = spark.createDataFrame([(1, ["x"], ["close()"], [])], "fn_id long, tokens_removed array<string>, imports_removed array<string>, calls_removed array<string>")
    assert [tuple(r) for r in X.rule_matches(delta, rules).collect()] == [(1, "CWE-404", "close()")]
    adv = spark.createDataFrame([("A", ["79"]), ("A", ["79"])], "id string, cwes array<string>")
    assert {tuple(r) for r in X.advisory_matches(d, adv).collect()} == {("2", "A"), ("3", "A")}
    assert X.severity_matrix(d.limit(0)).count() == 0
