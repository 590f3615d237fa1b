import csv
import glob
import json
import re

from pyspark.sql import functions as F

from simlattice import cli
from simlattice.operators import longitudinal as L
from simlattice.operators import security as X
from simlattice.sinks import documents, studies
from simlattice.sources import tables

SNAP = "tag string, idx long, package string, func string, file string, cluster string, score double"
SNAPS = [("v1", 0, "p", "a", "f", "c1", 0.9), ("v1", 0, "p", "b", "g", "c2", 0.4), ("v2", 1, "p", "a", "f", "c1", 0.9), ("v2", 1, "p", "d", "g", "c2", 0.8), ("v3", 2, "p", "a", "f", "c1", 0.8)]


def study(spark):
    rel = spark.createDataFrame([("v1", 0, 4, 40, 0.75), ("v2", 1, 5, 44, 0.75), ("v3", 2, 5, 50, 0.8)], "tag string, idx long, clusters long, functions long, identify double")
    s = spark.createDataFrame(SNAPS, SNAP)
    return studies.study_tables(s, rel, s.groupBy("tag", "idx", F.col("cluster").alias("shape_hash")).agg(F.count("*").alias("size")))


def test_study(spark, tmp_path):
    t = study(spark)
    text = "\n".join(studies.study_report(t, "x"))
    assert "3 releases" in text and "| v1 | 0 | 40 | 4 | 2 |" in text and "- seen at all: 2\n- in half of the releases or more: 2 (100%, high)\n- in all of them: 1" in text
    c = L.resolution_counts(t["outlier-resolution"]).first()
    assert f"- ended: {c['total']}" in text and c["total"] == 2 and f"(rejoined): {c['rejoined']}" in text
    more = "\n".join(studies.analysis_report(t, "x"))
    assert "| identify |" in more and "+5.00 functions and +0.50 clusters" in more and "v1 → v2" in more
    studies.write_study(t, str(tmp_path))
    assert {p.name for p in tmp_path.iterdir()} == {"releases", "thresholds", "cluster-tracking", "outlier-tracking", "outlier-resolution"}
    with open(glob.glob(f"{tmp_path}/outlier-tracking/*.csv")[0]) as f:
        rows = list(csv.DictReader(f))
    assert {r["func"]: r["num_releases"] for r in rows} == {"a": "3", "b": "1", "d": "1"}
    nothing = {k: d.limit(0) for k, d in t.items()}
    assert "None were tracked." in "\n".join(studies.study_report(nothing, "x")) and "None ended." in "\n".join(studies.study_report(nothing, "x"))


def test_verification(spark):
    d = spark.createDataFrame([("p", "a", "f", "v1", "v2", "c", "LIKELY_FIX", "2 fixes"), ("p", "b", "f", "v1", "v2", "c", "ARTEFACT", "same"), ("p", "d", "f", "v2", "v3", "c", "DELETED", "gone")], "package string, func string, file string, outlier_in string, gone_by string, cluster string, verdict string, evidence string")
    text = "\n".join(studies.verification_report(d, "x", "v1 v2 v3"))
    assert "Fixes: 1 of 3" in text and "prove nothing: 1" in text and text.index("p/a (v1 → v2)") < text.index("p/d (v2 → v3)")


FINDINGS = [{"id": "1", "cwe": "CWE-79", "cwe_name": "Scripts", "pass": "A", "severity": "Low", "confidence": "High", "cluster_id": "c<1>", "reason": "r1", "verification": {"status": "confirmed"}}, {"id": "2", "cwe": "CWE-79", "pass": "A", "severity": "High", "confidence": "Low", "cluster_id": "c<1>", "reason": "worst & last", "verification": {"status": "partial"}}, {"id": "3", "cwe": "CWE-8", "pass": "B", "severity": "Info", "package": "q", "verification": {"status": "refuted"}}]


def test_findings(spark, tmp_path, capsys):
    (tmp_path / "m.json").write_text(json.dumps({"findings": FINDINGS}))
    assert cli.main(["findings", str(tmp_path / "m.json")]) == 0
    page, text = (tmp_path / "m.html").read_text(), (tmp_path / "m.md").read_text()
    assert "c&lt;1&gt;" in page and "worst &amp; last 2'>2</td>" in page and page.index(">CWE-8<") < page.index(">CWE-79<")
    assert "| `c<1>` | · | H2 |" in text and "- CWE-79 = Scripts (structural)" in text and "## 2 (Medium)" in text and "## 3" not in text
    cells = {(r["row"], r["cwe"]): r for r in X.worst_cells(tables.findings(spark, str(tmp_path / "m.json"))).collect()}
    assert cells["c<1>", "CWE-79"]["worst"] == "High" and cells["c<1>", "CWE-79"]["findings"] == 2 and len(cells) == 2
    empty = tables.findings(spark, str(tmp_path / "m.json")).limit(0)
    assert "</html>" in "".join(studies.findings_page(empty, "x"))


def test_study_command(spark, tmp_path):
    (tmp_path / "releases.csv").write_text("tag,idx,clusters,functions\nv1,0,4,40\nv2,1,5,44\n")
    for tag, funcs in (("v1", "ab"), ("v2", "a")):
        (tmp_path / f"outliers-{tag}.json").write_text(json.dumps([{"package": "p", "func": f, "file": f"/repo/{f}", "candidates": [{"cluster_id": "c", "score": 0.8}]} for f in funcs]))
    assert cli.main(["study", str(tmp_path)]) == 0
    assert "- ended: 1" in (tmp_path / "report.md").read_text() and "Drift" in (tmp_path / "analysis.md").read_text() and (tmp_path / "tables/releases").is_dir()


def test_calibrate_command(spark, tmp_path, capsys):
    few, repo = tmp_path / "few", tmp_path / "repo"
    few.mkdir(), repo.mkdir()
    (few / "a.go").write_text("package p\nfunc F() error { if x := g(); x != nil { return x }; return nil }\n")
    assert cli.main(["calibrate", "--repo", str(few)]) == 1 and "too few" in capsys.readouterr().err
    for i in range(4):
        (repo / f"f{i}.go").write_text(f'package p\nimport "fmt"\nfunc F{i}() error {{ if x := g(); x != nil {{ fmt.Println(x); return x }}; fmt.Print(1); return nil }}\n')
    for i in range(80):
        (repo / f"n{i}.go").write_text(f"package q\nfunc N{i}() {{ " + " ".join(["a = b", "f()", "if x { }", "for { }", "go h()", "return"][(i >> k) % 6 if k < 6 else (i * k) % 6] + ";" for k in range(9)) + " }\n")
    assert cli.main(["calibrate", "--repo", str(repo), "--rounds", "2"]) == 0
    out = capsys.readouterr().out
    assert "84 eligible functions, 2 resamples" in out and "knee" in out and "sequence threshold" in out and "sensitivity: " in out
    lines = open(glob.glob(f"{repo}/.simlattice/calibration.csv/part-*")[0]).read().splitlines()
    assert lines[0].startswith("threshold,") and len(lines) > 3


def test_advisory_names(spark):
    names = spark.range(1).select(tables.advisory_names(F.lit("x.org/m/v3")).alias("n")).first()["n"]
    assert names[:2] == ["x.org/m/v3", "x.org/m"] and set(names) == {"x.org/m", *[f"x.org/m/v{i}" for i in range(2, 10)]}
    got = tables.advisories_of(spark.createDataFrame([("x.org/m/v3",), ("y",)], "module string"), spark.createDataFrame([("A", "x.org/m", None, ["2", "1", "1"]), ("A", "x.org/m/v2", "s", None), ("B", "z", "s", None)], "id string, name string, summary string, fixed array<string>")).collect()
    assert [(r["module"], r["id"]) for r in got] == [("x.org/m/v3", "A")]


def test_pattern_index(spark):
    from test_clustering import FMT, SEQ, corpus

    from simlattice.plans.analysis import Analysis

    a = Analysis(corpus(spark, [(SEQ, *FMT)] * 3))
    assert "0 patterns" in "\n".join(documents.pattern_index(a, "x"))
    a.__dict__["clusters"] = a.clusters.withColumn("label", F.lit("retry"))
    text = "\n".join(documents.pattern_index(a, "x"))
    assert "1 patterns" in text and "## retry" in text and "- p.f0" in text


def test_report_page(spark):
    from simlattice.plans.analysis import Analysis
    from simlattice.plans.catalogue import LOOSE
    from simlattice.schema import Config
    from simlattice.sources import corpora

    fns = corpora.user_weeks(spark, "/root/testdata/sf0.01").withColumn("body", F.concat(F.lit("func <"), "name", F.lit(">")))
    a = Analysis(fns, Config(identify_threshold=LOOSE))
    page = "\n".join(documents.html_report(a, "<t>"))
    members = a.members.count()
    assert "<t>" not in page and page.count("<div class=card><h3>high") + page.count("<div class=card><h3>medium") + page.count("<div class=card><h3>low") == a.clusters.count() > 10
    assert page.count("<details>") == members and "func &lt;user" in page and page.count("<div class=card><h3>near ") == a.near_misses.where("rank = 1").select("cluster_id").distinct().count() > 3
    assert "class='chip lack'" in page and "class='chip add'" in page and "nearly: <span class=chip>" in page and page.count("<ul>") == page.count("</ul>")
    order = [(("high", "medium", "low").index(t), int(k)) for t, k in re.findall("<h3>(high|medium|low) ([0-9]+):", page)]
    assert order == sorted(order) and len(order) == a.clusters.count()
