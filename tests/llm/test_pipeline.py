import importlib.util
from pathlib import Path

from simlattice.llm import exact_dedup, mixing, near_dedup, packing, quality


def load():
    spec = importlib.util.spec_from_file_location("corpus_pipeline", Path(__file__).parents[2] / "corpus_pipeline.py")
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_stages_one_after_the_other(spark, sf):
    p, docs = load(), spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in p.STAGES]
    assert names == ["quality rules", "exact dedup", "near dedup", "mixing", "packing"]
    d, counts = docs, []
    for _, stage in p.STAGES:
        d = stage(spark, d, sf)
        counts.append(d.count())
        if len(counts) < 5:
            assert d.columns == docs.columns
    # the decisions, by the operators' own verdicts
    good = {r["doc_id"] for r in quality.judge(docs).where("keep").collect()}
    a = docs.where(docs["doc_id"].isin(list(good)))
    b = a.where(~a["doc_id"].isin([r["doc_id"] for r in exact_dedup.duplicates(a).collect()]))
    c = b.where(~b["doc_id"].isin([r["doc_id"] for r in near_dedup.near_duplicates(b).collect()]))
    assert counts[:3] == [len(good), b.count(), c.count()]
    placed = mixing.mix(c).where("doc_from = 0").count()
    assert counts[3] == placed
    assert counts[4] == packing.pack(mixing.mixed_documents(c)).count() == p.run(spark, sf).count()


def test_empty(spark, empty, sf):
    d = empty
    for _, stage in load().STAGES:
        d = stage(spark, d, sf)
    assert d.count() == 0


def test_rough_rows(spark, docs, sf):
    d = docs
    for _, stage in load().STAGES:
        d = stage(spark, d, sf)
    assert d.count() > 0


def test_clashing_columns(spark, clashing, docs, sf):
    """Every stage with columns named like the operators' own; what is kept is what is kept without them."""
    for _, stage in load().STAGES[:4]:
        plain, d = stage(spark, docs, sf), stage(spark, clashing, sf)
        assert d.columns == clashing.columns
        assert sorted(map(str, d.select("doc_id", "text").collect())) == sorted(map(str, plain.select("doc_id", "text").collect()))
    assert load().STAGES[4][1](spark, clashing, sf).count() == load().STAGES[4][1](spark, docs, sf).count()


def test_run_leaves_only_its_result(spark, sf):
    from simlattice.llm.common import shared_dir

    before = set(Path(shared_dir(spark)).glob("pipeline-*/*"))
    out = load().run(spark, sf)
    assert out.count() > 0 and [x.name for x in set(Path(shared_dir(spark)).glob("pipeline-*/*")) - before] == ["4"]
