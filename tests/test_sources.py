import json

import pytest
from pyspark.sql import functions as F

from simlattice import cli
from simlattice.operators import blocking
from simlattice.plans.analysis import by_language
from simlattice.schema import FUNCTIONS, complete
from simlattice.sinks import store
from simlattice.sources import corpora, files, tables
from simlattice.streaming import ingest

GO = 'package p\nimport "fmt"\nfunc F%d() error { if x := g(); x != nil { fmt.Println(x); return x }; fmt.Print(1); return nil }\n'


@pytest.fixture
def tree(tmp_path):
    for name in ("a/x.go", "a/b/y.go", "a/x_test.go", "a/z.pb.go", "a/mock_z.go", "vendor/v.go", "a/Vendor/w.go", "a/zz_generated.go", "a/J.java", "a/readme.md", "top.go"):
        p = tmp_path / "repo" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(GO % 1)
    (tmp_path / "repo/a/broken.go").write_text("package p\nfunc f( {")
    return tmp_path / "repo"


def test_tree(spark, tree):
    d = files.scan(spark, str(tree))
    assert {(r["pkg_dir"], r["name"], r["lang"]) for r in d.collect()} == {("a", "x.go", "golang"), ("a/b", "y.go", "golang"), ("a", "broken.go", "golang"), ("a", "J.java", "java"), (".", "top.go", "golang")}
    assert {r["pkg_dir"]: len(r["files"]) for r in files.packages(d).collect()} == {"a": 3, "a/b": 1, ".": 1}
    rows = files.read_tree(spark, str(tree))
    assert rows.schema.names == FUNCTIONS.names and rows.count() == 3
    r = rows.first()
    assert r["direct_imports"] == ["fmt"] and r["call_targets"] == ["fmt.Print", "fmt.Println"] and len(r["token_seq_hash"]) == (len(r["token_seq"]) - 1) // 2
    with pytest.raises(Exception, match="(?i)path"):
        files.scan(spark, str(tree / "nowhere")).count()
    assert files.parse_go(spark.createDataFrame([(None, None), ("a", "")], "path string, content string")).count() == 0


RECORD = {"file": "A.java", "package_name": "j", "imports": ["a.B"], "functions": [{"name": "m", "package_name": "j", "file_path": "A.java", "start_line": 3, "token_seq": [22, 18, 23, 7, 7], "token_seq_hash": [1], "call_targets": ["b", "a", "a"], "direct_imports": ["a.B"]}, {"name": "t", "package_name": "j", "token_seq": [1], "test_code": True}]}


def test_records(spark, tmp_path):
    (tmp_path / "A.json").write_text(json.dumps(RECORD))
    (tmp_path / "bad.json").write_text("{nonsense")
    r = files.read_records(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0]["lang"] == "java" and r[0]["call_targets"] == ["a", "b"] and r[0]["features"]["cyclomatic_complexity"] == 0 and r[0]["token_seq_hash"] != [1] and not r[0]["is_constructor"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/A.json").write_text(json.dumps(RECORD))
    for _ in range(2):
        ingest.append(ingest.functions(spark, str(tmp_path / "in")), str(tmp_path / "index"), str(tmp_path / "state"), available_now=True).awaitTermination()
    fns = spark.read.parquet(str(tmp_path / "index/functions"))
    assert fns.count() == 1 and spark.read.parquet(str(tmp_path / "index/postings")).count() == blocking.postings(fns).count() == 2


def test_append_to_a_stored_index(spark, tmp_path):
    """init, append, query: the appended rows are in the same tables, and a second try of a batch adds nothing."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/A.json").write_text(json.dumps(RECORD))
    index = str(tmp_path / "index")
    go = complete(spark.createDataFrame([(i, f"f{i}", "p", "golang", [0, 1, 14, 7, 7 + i], ["fmt"], ["fmt.Print"]) for i in range(4)], "fn_id long, name string, package string, lang string, token_seq array<int>, direct_imports array<string>, call_targets array<string>"))
    store.write_index(by_language(go), index)
    before = tables.table(spark, index, "functions").count()
    ingest.append(ingest.functions(spark, str(tmp_path / "in")), index, str(tmp_path / "state"), available_now=True).awaitTermination()
    ingest.append(ingest.functions(spark, str(tmp_path / "in")), index, str(tmp_path / "again"), available_now=True).awaitTermination()
    fns, posts = tables.table(spark, index, "functions"), tables.table(spark, index, "postings")
    assert before == 4 and fns.count() == 5 and "batch" not in fns.columns and fns.where("lang = 'java'").first()["name"] == "m"
    assert posts.where("lang = 'java'").count() == 2 and posts.where("lang = 'golang'").count() == blocking.postings(blocking.eligible(go)).count()
    assert by_language(fns)["java"].fns.count() == 1 and by_language(fns)["golang"].postings.count() > 0


def test_complete(spark):
    r = complete(spark.createDataFrame([(1, [3, 1, 2], ["b", None, "a", "b"])], "FN_ID long, token_seq array<int>, direct_imports array<string>")).first()
    assert r["direct_imports"] == ["a", "b"] and r["name"] == "" and r["features"]["control_flow"]["if"] == 0 and len(r["token_seq_hash"]) == 1 and r["call_targets"] == []


def test_token_columns(spark):
    d = spark.createDataFrame([([0, 7], 2)], "t array<int>, n int")
    assert d.select(files.trailing_returns(F.col("t"), F.col("n"))).first()[0] == [0, 7, 7, 7] and d.select(files.control_flow(F.col("t"))["if"]).first()[0] == 1
    d = spark.createDataFrame([(["testing"], ["// Code generated x"]), (["os"], ["x"])], "i array<string>, c array<string>")
    assert [tuple(r) for r in d.select(files.is_test(F.col("i")), files.is_generated(F.col("c"))).collect()] == [(True, True), (False, False)]


def test_study_files(spark, tmp_path):
    rel = spark.createDataFrame([("v1", 0), ("v2", 1)], "tag string, idx long")
    assert tables.snapshots(spark, str(tmp_path), rel).count() == 0
    (tmp_path / "outliers-v1.json").write_text(json.dumps([{"package": "p", "func": "f", "file": "/repo/a", "candidates": [{"cluster_id": "c", "score": 0.8}]}, {"package": "p", "func": "g"}]))
    (tmp_path / "outliers-v2.json").write_text("not json")
    assert sorted(map(tuple, tables.snapshots(spark, str(tmp_path), rel).collect())) == [("v1", 0, "p", "f", "/repo/a", "c", 0.8), ("v1", 0, "p", "g", "", "", 0.0)]
    (tmp_path / "r.csv").write_text("a,b,c\nx,1,2.5\n,z,\n")
    assert [tuple(r) for r in tables.csv(spark, str(tmp_path / "r.csv"), "a string, b int, c double").collect()] == [("x", 1, 2.5), ("", 0, 0.0)]
    assert tables.csv(spark, str(tmp_path / "no.csv"), "a string, b int").count() == 0
    (tmp_path / "kv").write_text("a = 1\nnothing\nb=x=y\n")
    assert {tuple(r) for r in tables.key_values(spark, str(tmp_path / "kv")).collect()} == {("a", "1"), ("b", "x=y")}
    (tmp_path / "adv.json").write_text(json.dumps([{"id": "A", "cwes": ["CWE-79"]}, {"id": "A"}, {"id": "B"}]))
    assert tables.advisories(spark, str(tmp_path / "adv.json")).count() == 2
    for name, body in (("list", [{"id": "1", "cwe": "CWE-1"}]), ("object", {"repo": "r", "findings": [{"id": "2", "severity": "High", "verification": {"status": "partial"}}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    assert [tables.findings(spark, str(tmp_path / f"{n}.json")).first()["id"] for n in ("list", "object")] == ["1", "2"]
    assert tables.head_commit(str(tmp_path / "none")) == ""
    pages = spark.createDataFrame([('<td class="shape">ab12</td><td class="shape">ab12</td>',)], "html string")
    assert [r[0] for r in tables.shapes_in_page(pages).collect()] == ["ab12"]


def test_adapters_take_whole_texts(spark, sf_small="/root/testdata/sf0.001"):
    d = corpora.documents(spark, sf_small)
    assert d.count() == spark.read.parquet(f"{sf_small}/documents.parquet").where("text is not null").count()
    longest = spark.read.parquet(f"{sf_small}/documents.parquet").orderBy(F.desc("n_chars")).first()
    import re

    want = [x for x in (s.strip(" ") for s in re.findall(r"[^.!?\n\r]+", longest["text"].lower())) if x]
    assert len(d.where(F.col("fn_id") == longest["doc_id"]).first()["token_seq"]) == len(want)


def test_commands(spark, tmp_path, capsys):
    repo = tmp_path / "project"
    shape = "package p\nimport \"fmt\"\nfunc F%d() error { if x := g(); x != nil { fmt.Println(x); return x }; fmt.Print(1); return nil }\n"
    repo.mkdir()
    for i in range(4):
        (repo / f"f{i}.go").write_text(shape % i)
    for i in range(80):  # other functions, each of its own shape
        (repo / f"n{i}.go").write_text(f"package q\nfunc N{i}() {{ " + " ".join(["a = b", "f()", "if x { }", "for { }", "go h()", "return"][(i >> k) % 6 if k < 6 else (i * k) % 6] + ";" for k in range(9)) + " }\n")
    assert cli.main(["version"]) == 0 and cli.main(["init", "--repo", str(repo)]) == 0
    index = repo / ".simlattice"
    assert {p.name for p in index.iterdir()} >= {"functions", "postings", "doc_freq", "clusters", "cluster_members", "near_misses", "report.html"}
    c = tables.clusters(spark, str(index)).where("size = 4").first()
    assert c is not None and tables.cluster_by_shape(spark, str(index), c["shape_hash"]).count() == 1 and tables.cluster_by_ordinal(spark, str(index), c["tier"], c["ordinal"]).count() == 1
    assert tables.cluster_count(spark, str(index), c["tier"]) >= 1 and tables.first_stage_with_rows(spark, str(index))[1] == "identified" and tables.orphans(spark, str(index), "java").count() == 0
    capsys.readouterr()
    assert cli.main(["query", "cluster", c["shape_hash"], "--repo", str(repo)]) == 0 and "p.F0" in capsys.readouterr().out
    assert cli.main(["query", "cluster", c["shape_hash"][:5], "--repo", str(repo)]) == 1
    assert cli.main(["query", "outlier", "--repo", str(repo), "--format", "json"]) == 0 and cli.main(["query", "outlier", "--repo", str(repo)]) == 0
    capsys.readouterr()
    assert cli.main(["export", "--repo", str(repo)]) == 0
    x = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert x["corpus_size"] >= 4 and any(len(k["members"]) == 4 for k in x["clusters"])
    assert cli.main(["analyze", "--repo", str(repo)]) == 0 and c["shape_hash"][:6] in (index / "report.html").read_text()
