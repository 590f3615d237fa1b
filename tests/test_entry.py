import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).parents[1]


def test_entry(spark):
    sys.path.insert(0, str(REPO))
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["i", "j", "shared", "seq_s", "imp_s", "call_s", "geo"] and e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_works_without_the_subpackage(tmp_path):
    """The repository as it is once the training-data operators are taken away."""
    for x in ("simlattice", "__spark_entry__.py"):
        (shutil.copytree if (REPO / x).is_dir() else shutil.copy)(REPO / x, tmp_path / x)
    shutil.rmtree(tmp_path / "simlattice" / "llm", ignore_errors=True)
    for left in (False, True):
        if left:
            (tmp_path / "simlattice" / "llm" / "__pycache__").mkdir(parents=True)
        code = "import __spark_entry__ as e; q = e.queries(); assert 'clusters' in q and not any(x.startswith('op') and x[2].isdigit() for x in q); print(len(e.oracle_sql()))"
        run = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
        assert run.returncode == 0, run.stderr


def test_an_error_inside_the_subpackage_is_an_error(tmp_path):
    for x in ("simlattice", "__spark_entry__.py"):
        (shutil.copytree if (REPO / x).is_dir() else shutil.copy)(REPO / x, tmp_path / x)
    (tmp_path / "simlattice" / "llm").mkdir(exist_ok=True)
    (tmp_path / "simlattice" / "llm" / "queries.py").write_text("import no_such_module\n")
    run = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert run.returncode and "no_such_module" in run.stderr


def test_nothing_else_imports_the_subpackage():
    for p in (REPO / "simlattice").rglob("*.py"):
        if "llm" not in p.relative_to(REPO).parts:
            assert "llm" not in p.read_text(), p


def _value(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", ["clusters", "event_groups", "common_sequence", "near_misses", "outliers", "cluster_rows", "export", "profile", "resolutions", "chains", "severity_matrix", "window_hashes", "knee"])
def test_queries_agree_with_their_sql(spark, name):
    import duckdb

    from simlattice.plans import catalogue, oracles

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = catalogue.queries()[name](spark, sf)
    r = con.execute(oracles.oracle_sql()[name])
    names = [d[0] for d in r.description]
    want = sorted("|".join(_value(v) for _, v in sorted(zip(names, x))) for x in r.fetchall())
    assert sorted(names) == sorted(df.columns)
    assert sorted("|".join(_value(v) for _, v in sorted(x.asDict().items())) for x in df.collect()) == want
    assert want, name


def test_the_gate_of_complete_linkage_matters(spark, monkeypatch):
    """Without it the groups of events are others, so the SQL does check it."""
    from simlattice.operators import cluster
    from simlattice.plans import catalogue

    sf = "/root/testdata/sf0.01"
    with_gate = sorted(map(tuple, catalogue.event_groups(spark, sf).collect()))
    kernel = cluster.agglomerate
    monkeypatch.setattr(cluster, "agglomerate", lambda edges, n, threshold, floor=None: kernel(edges, n, 0.0, floor))
    assert sorted(map(tuple, catalogue.event_groups(spark, sf).collect())) != with_gate
