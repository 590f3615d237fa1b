import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from simlattice.operators import blocking, deltas, near_miss, report
from simlattice.operators import cluster as C
from simlattice.operators import profile as P
from simlattice.plans import catalogue
from simlattice.plans.analysis import Analysis
from simlattice.runtime import with_position
from simlattice.schema import Config, complete

SCHEMA = "fn_id long, name string, package string, file_path string, start_line int, token_seq array<int>, direct_imports array<string>, call_targets array<string>"
SEQ = [0, 1, 14, 7, 7]
FMT = (["fmt"], ["fmt.Println"])


def corpus(spark, rows, pad=100):
    """Rows (seq, imports, calls[, name]) and noise that resembles nothing."""
    all_ = [(i, r[3] if len(r) > 3 else f"f{i}", "p", "a.go", i, r[0], r[1], r[2]) for i, r in enumerate(rows)]
    for i in range(pad - len(rows)):
        b = 10_000 + 100 * i
        all_.append((1000 + i, f"noise{i}", "z", "n.go", i, [b, b + 1, b + 2, b + 3, b + 4], [], []))
    return complete(spark.createDataFrame(all_, SCHEMA))


def run(spark, rows, pad=100, **cfg):
    a = Analysis(corpus(spark, rows, pad), Config(**cfg))
    groups = {}
    for r in a.members.collect():
        groups.setdefault(r["cluster_id"], set()).add(r["fn_id"])
    return a, sorted(groups.values(), key=lambda g: (-len(g), min(g))), {r[0] for r in a.orphans.collect()}


def test_three_alike(spark):
    a, groups, orphans = run(spark, [(SEQ, *FMT)] * 3)
    assert groups == [{0, 1, 2}] and orphans == set()
    c = a.clusters.first()
    assert c["size"] == 3 and c["common_seq"] == SEQ and c["tier"] == "high" and c["mean_score"] == 1.0 and c["coherence"] == 1.0 and c["top_imports"] == ["fmt"]


def test_no_chaining(spark):
    two = (["fmt", "os"], ["fmt.Println", "os.Exit"])
    rows = [(SEQ, *two), (SEQ, *two), (SEQ, ["fmt", "os", "io"], ["fmt.Println", "os.Exit", "io.Close"]), (SEQ, ["io", "net"], ["io.Close", "net.Dial"])]
    assert run(spark, rows, identify_threshold=0.7)[1] == [{0, 1, 2}]


def test_larger_first(spark):
    other = [3, 4, 18, 16, 7, 4, 18]
    assert run(spark, [(other, ["x"], ["x.Y"])] * 4 + [(SEQ, *FMT)] * 3)[1] == [{0, 1, 2, 3}, {4, 5, 6}]


def test_orphans(spark):
    _, groups, orphans = run(spark, [(SEQ, *FMT), (SEQ, ["os"], ["os.Exit"])])
    assert groups == [] and orphans == {0, 1}
    _, groups, orphans = run(spark, [(SEQ, *FMT)] * 3 + [(SEQ, ["os"], ["os.Exit"])])
    assert groups == [{0, 1, 2}] and orphans == {3}
    assert run(spark, [(SEQ, *FMT)])[2] == set()
    assert run(spark, [(SEQ, *FMT, "init"), (SEQ, ["os"], ["os.Exit"])])[2] == {1}


def test_dropped_groups(spark):
    assert run(spark, [(SEQ, *FMT)] * 2)[1:] == ([], set())  # too small, and no orphans either
    assert run(spark, [(SEQ, *FMT)] * 5)[1] == []  # 5 of 100 are a primitive
    assert run(spark, [(SEQ, *FMT, "init")] * 3)[1] == []
    assert run(spark, [(SEQ, ["testing"], ["testing.Run"])] * 3)[1] == []
    assert run(spark, [(SEQ, [f"{'testing' if i < 2 else 'fmt'}", "a", "b", "c"], ["a.B"]) for i in range(4)])[1] == [{0, 1, 2, 3}]  # half isn't most


def test_empty(spark):
    a = Analysis(corpus(spark, [], 0))
    assert a.members.count() == a.clusters.count() == a.near_misses.count() == a.outliers().count() == 0
    assert report.means(a.clusters, a.avg_scores).first()["total_clusters"] == 0
    x = a.export().first()
    assert x["corpus_size"] == 0 and x["clusters"] == [] and x["orphans"] == []
    assert report.explain_scores(report.score_histogram(a.avg_scores)).first()["verdict"] == "none"


def naive_links(edges, n, threshold):
    """Greedy complete linkage on a full matrix."""
    s = {}
    for i, j, x in edges:
        s[i, j] = s[j, i] = x
    groups = [[v] for v in range(n)]
    for i, j, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        a, b = next(g for g in groups if i in g), next(g for g in groups if j in g)
        if a is not b and all(s.get((x, y), 0) >= threshold for x in a for y in b):
            groups.remove(a)
            groups.remove(b)
            groups.append(a + b if len(a) >= len(b) else b + a)
    return sorted(g for g in groups if len(g) > 1)


def test_kernel():
    r = random.Random(1)
    for _ in range(60):
        n = r.randrange(2, 12)
        edges = [(i, j, round(r.uniform(0.7, 1), 2)) for i in range(n) for j in range(i + 1, n) if r.random() < 0.7]
        edges = [e for e in edges if e[2] >= 0.75]
        assert sorted(C.agglomerate(edges, n, 0.75)) == naive_links(edges, n, 0.75)
    assert C.agglomerate([(0, 1, 0.7)], 2, 0.6, 0.75) == []


def test_linking_in_rounds_is_the_kernel(spark):
    """Many random components at once, with ties, against the kernel's groups and member order."""
    r, rows, want = random.Random(7), [], set()
    for c in range(40):
        n = r.randrange(2, 14)
        edges = [(i, j, round(r.uniform(0.7, 1), 1 + c % 2)) for i in range(n) for j in range(i + 1, n) if r.random() < 0.8]
        edges = [e for e in edges if e[2] >= 0.75]
        rows += [(c, 100 * c + i, 100 * c + j, s) for i, j, s in edges]
        want |= {(c, tuple(100 * c + v for v in g)) for g in C.agglomerate(edges, n, 0.75)}
    d = C.linked_in_rounds(spark.createDataFrame(rows, "component long, a long, b long, score double"))
    got = {}
    for x in d.collect():
        got.setdefault((x["component"], x["g"]), []).append((x["pos"], x["v"]))
    assert {(c, tuple(v for _, v in sorted(g))) for (c, _), g in got.items()} == want
    assert all([p for p, _ in sorted(g)] == list(range(len(g))) for g in got.values())
    assert C.linked_in_rounds(spark.createDataFrame([], "component long, a long, b long, score double")).count() == 0
    assert C.linked_in_rounds(spark.createDataFrame([(0, 0, 1, 0.7), (1, 5, 6, 0.8)], "component long, a long, b long, score double"), 0.75).count() == 2


def test_large_components_are_linked_in_rounds(spark, monkeypatch):
    from simlattice.plans.catalogue import LOOSE
    from simlattice.sources import corpora

    a = Analysis(corpora.user_weeks(spark, "/root/testdata/sf0.001"), Config(identify_threshold=LOOSE))
    want = sorted(map(tuple, a.groups.select("cluster_id", "fn_id", "member_pos").collect()))
    monkeypatch.setattr(C, "KERNEL_EDGES", 5)
    got = sorted(map(tuple, C.link_groups(a.edges, a.fns, a.cfg).select("cluster_id", "fn_id", "member_pos").collect()))
    assert got == want and want


def test_near_miss_search_loses_none(spark):
    """At thresholds above and below two thirds, and below one: every pair that reaches the bar is possible."""
    r, rows = random.Random(11), []
    for i in range(60):
        seq = [t if r.random() > 0.2 else r.randrange(22) for t in r.choice([[0, 1, 14, 7, 7, 16, 2], [3, 4, 18, 16, 7, 4, 18, 2, 5, 6, 1, 2]])]
        rows.append((seq, r.sample("abcdef", r.randrange(4)), r.sample(["a.X", "b.Y", "c.Z", "d.W"], r.randrange(4))))
    fns = corpus(spark, rows, 60)
    members = spark.createDataFrame([(i % 6, i, i // 6) for i in range(30)], "cluster_id long, fn_id long, member_pos int")
    lone = blocking.comparable(fns).where("fn_id >= 30")
    sigs = P.signatures(members, fns)
    both = lone.select("fn_id", "enc", F.col("imps").alias("im"), F.col("calls").alias("ca")).join(sigs.select("cluster_id", F.col("enc").alias("e"), "imps", "calls", "w"), F.lit(True))
    from simlattice.functions import scalars as S

    seq = S.seq_similarity(F.col("enc"), F.col("e"))
    score = both.groupBy("fn_id", "cluster_id").agg((F.sum((seq + S.jaccard(F.col("im"), F.col("imps")) + S.jaccard(F.col("ca"), F.col("calls"))) / 3 * F.col("w")) / F.sum("w")).alias("s"), F.max(seq).alias("top")).collect()
    for t in (0.75, 0.65, 0.5, 0.4, 0.3):
        cfg = Config(identify_threshold=t)
        got = {tuple(x) for x in near_miss.possible(lone, sigs, cfg).collect()}
        need = {(x["fn_id"], x["cluster_id"]) for x in score if x["s"] >= t and x["top"] >= cfg.seq_fast_reject}
        assert need <= got and (t < 0.6 or len(got) < 180), t


def test_components(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(200)] + [(1000 + r.randrange(60), 1000 + r.randrange(60)) for _ in range(40)]
    parent = {v: v for e in links for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {x["fn_id"]: x["component"] for x in C.components(spark.createDataFrame(links, "i long, j long")).collect()}
    assert got == {v: root(v) for v in parent if any(v in e and e[0] != e[1] for e in links)}
    assert C.components(spark.createDataFrame([], "i long, j long")).count() == 0


def test_random_corpus_against_plain_python(spark):
    r = random.Random(3)
    rows = []
    for _ in range(60):
        base = r.choice([[0, 1, 14, 7, 7, 16, 2], [3, 4, 18, 16, 7, 4, 18, 2], [14, 16, 14, 16, 17, 7, 0]])
        seq = [t if r.random() > 0.08 else r.randrange(22) for t in base]
        rows.append((seq, r.sample(["a", "b", "c", "d"], 3), r.sample(["a.X", "b.Y", "c.Z", "d.W", "e.V"], 4)))
    fns = corpus(spark, rows, 400)
    got = {(x["i"], x["j"]): x for x in blocking.scored_pairs(blocking.shared_pairs(blocking.postings(blocking.eligible(fns))), fns).collect()}
    data = {x["fn_id"]: x for x in fns.collect()}
    freq = Counter(h for x in data.values() for h in x["token_seq_hash"])

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    jac = lambda a, b: len({*a} & {*b}) / len({*a} | {*b}) if a or b else 0.0
    want, edges, below = {}, [], set()
    for i in range(60):
        for j in range(i + 1, 60):
            a, b = data[i], data[j]
            ca, cb = Counter(a["token_seq_hash"]), Counter(b["token_seq_hash"])
            shared = sum(ca[h] * cb[h] for h in ca if freq[h] <= 300)
            if not shared or shared < (2 if min(len(a["token_seq_hash"]), len(b["token_seq_hash"])) >= 2 else 1):
                continue
            s = 1 - distance(a["token_seq"], b["token_seq"]) / max(len(a["token_seq"]), len(b["token_seq"]))
            if s < 0.4:
                continue
            geo = (s * jac(a["direct_imports"], b["direct_imports"]) * jac(a["call_targets"], b["call_targets"])) ** (1 / 3)
            want[i, j] = geo
            (edges.append((i, j, geo)) if geo >= 0.75 else below.update((i, j)))
    assert set(got) == set(want) and all(got[k]["geo"] == pytest.approx(v) for k, v in want.items())
    order = sorted(range(60), key=lambda i: f"p/f{i}")
    place = {v: k for k, v in enumerate(order)}
    local = [(min(place[i], place[j]), max(place[i], place[j]), round(g, 12)) for i, j, g in edges]
    a = Analysis(fns)
    groups = {}
    for x in a.groups.collect():
        groups.setdefault(x["cluster_id"], []).append((x["member_pos"], place[x["fn_id"]]))
    assert sorted(sorted(v for _, v in g) for g in groups.values()) == sorted(sorted(g) for g in naive_links(local, 60, 0.75))
    assert {x[0] for x in a.below.collect()} == below
    scored = {(min(i, j), max(i, j)): g for i, j, g in edges}
    for g in groups.values():  # complete linkage: every pair inside is an edge
        ids = [order[v] for _, v in g]
        assert all((min(x, y), max(x, y)) in scored for x in ids for y in ids if x != y)
    shuffled = Analysis(fns.orderBy(F.rand(5)).repartition(7))
    assert sorted(map(str, shuffled.groups.collect())) == sorted(map(str, a.groups.collect()))


def test_pairs_are_dropped_before_functions_meet(spark):
    """Of the pairs that share a hash, only those that share enough and are of comparable lengths are candidates; edges need no more scores."""
    r = random.Random(5)
    rows = [([r.randrange(6) for _ in range(r.choice([5, 9, 40]))], r.sample("abcd", 3), r.sample("vwxyz", 4)) for _ in range(80)]
    rows += [([0, 1, 2, 3, 4, 5, i % 3], ["a", "b"], ["v", "w"][: 1 + i % 2]) for i in range(20)]
    able = blocking.eligible(corpus(spark, rows, 120))
    shared = blocking.shared_pairs(blocking.postings(able))
    scored = blocking.scored_pairs(shared, able)
    c = blocking.candidates(able)
    assert scored.count() <= c.count() < shared.count()
    full, short = blocking.compared(c, able), blocking.compared(c, able, least=0.75)
    text = lambda d: sorted(map(str, d.collect()))
    assert text(full) == text(scored) and text(blocking.edges(short)) == text(blocking.edges(full)) and 0 < short.count() < full.count()


def test_self_pairs_only_when_asked(spark):
    rows = [([5, 6, 5, 6, 5, 6, 5, 6, 5, 6, 5], [], [])]
    assert run(spark, rows)[2] == set() and run(spark, rows, compat=True)[2] == {0}


def test_stop_buckets(spark):
    fns = corpus(spark, [(SEQ, *FMT)] * 20, 40)
    index = blocking.postings(fns)
    assert blocking.shared_pairs(index, Config(max_bucket=19)).count() == 0 and blocking.stop_buckets(index, Config(max_bucket=19)).count() == 2
    assert blocking.shared_pairs(index, Config(max_bucket=20)).count() == 190


def test_positions(spark):
    d = spark.range(5000).select(F.xxhash64("id").alias("k"))
    got = [r["position"] for r in with_position(d, [F.col("k")]).orderBy("k").collect()]
    assert got == list(range(5000)) and with_position(d.limit(0), [F.col("k")]).count() == 0


def test_member_scores_weigh_equal_members(spark):
    rows = [(SEQ, *FMT)] * 4 + [([0, 1, 14, 7, 16], ["fmt", "os"], ["fmt.Println"])] * 3 + [(SEQ, [], [])]
    fns = corpus(spark, rows, 8)
    m = spark.createDataFrame([(0, i, i) for i in range(8)], "cluster_id long, fn_id long, member_pos int")
    got = {x["fn_id"]: x["score"] for x in P.member_scores(m, fns).collect()}
    jac = lambda a, b: len({*a} & {*b}) / len({*a} | {*b}) if a or b else 0.0
    for i, (s, im, ca, *_) in enumerate(rows):
        each = [((1 - sum(x != y for x, y in zip(s, t)) / 5) + jac(im, jm) + jac(ca, cb)) / 3 for k, (t, jm, cb, *_) in enumerate(rows) if k != i]
        assert got[i] == pytest.approx(sum(each) / 7)
    c = P.coherence(m, fns).first()
    pairs = [(a, b) for a in range(8) for b in range(a)]
    assert c["coherence"] == pytest.approx(sum(jac(rows[a][1], rows[b][1]) for a, b in pairs) / len(pairs))
    assert P.coherence(spark.createDataFrame([(0, 0, 0)], m.schema), fns).first()["coherence"] == 1.0


def test_coherence_samples_by_stride(spark):
    fns = complete(spark.createDataFrame([(i, f"f{i}", "p", "a", i, SEQ, [f"i{i % 3}"], ["c"]) for i in range(120)], SCHEMA))
    m = spark.createDataFrame([(0, i, i) for i in range(120)], "cluster_id long, fn_id long, member_pos int")
    picked = range(0, 120, 2)
    pairs = [(a, b) for a in picked for b in picked if a < b]
    assert P.coherence(m, fns).first()["coherence"] == pytest.approx(sum(a % 3 == b % 3 for a, b in pairs) / len(pairs))


def test_whole_coherence_compares_all_members(spark):
    r = random.Random(2)
    sets = [(r.sample("abcd", r.randrange(4)), r.sample("xyz", r.randrange(1, 3))) for _ in range(130)]
    fns = complete(spark.createDataFrame([(i, f"f{i}", "p", "a", i, SEQ, *s) for i, s in enumerate(sets)] + [(130, "g", "p", "a", 1, SEQ, [], [])], SCHEMA))
    m = spark.createDataFrame([(0, i, i) for i in range(130)] + [(1, 130, 0)], "cluster_id long, fn_id long, member_pos int")
    jac = lambda a, b: len({*a} & {*b}) / len({*a} | {*b}) if a or b else 0.0
    pairs = [(sets[i], sets[j]) for i in range(130) for j in range(i)]
    got = {x["cluster_id"]: x for x in P.coherence(m, fns, whole=True).collect()}
    assert got[0]["coherence"] == pytest.approx(sum(jac(a[0], b[0]) for a, b in pairs) / len(pairs)) and got[0]["call_coherence"] == pytest.approx(sum(jac(a[1], b[1]) for a, b in pairs) / len(pairs))
    assert got[1]["coherence"] == got[1]["call_coherence"] == 1.0
    assert P.assemble(m.where("cluster_id = 0"), fns).first()["coherence"] == pytest.approx(got[0]["coherence"])


def test_shape_hashes_are_told_apart(spark):
    fns = corpus(spark, [(SEQ, *FMT)] * 9, 9)
    m = spark.createDataFrame([(i // 3, i, i % 3) for i in range(9)], "cluster_id long, fn_id long, member_pos int")
    h = {r["cluster_id"]: r["shape_hash"] for r in P.modal_shape(m, fns).collect()}
    assert h[1] == h[0] + "-1" and h[2] == h[0] + "-2"


def near(spark, extra):
    rows = [(SEQ, ["a/fmt", "b/io"], ["x", "y", "z"])] * 4 + extra
    return Analysis(corpus(spark, rows), Config(identify_min_size=3))


def test_near_misses(spark):
    lone = (SEQ[:4] + [16], ["a/fmt", "b/io"], ["x", "y", "z", "w"])
    a = near(spark, [lone])
    fns = a.fns
    m = spark.createDataFrame([(0, i, i) for i in range(4)], "cluster_id long, fn_id long, member_pos int")
    clusters, ids = P.assemble(m, fns), spark.createDataFrame([(4,)], "fn_id long")
    found = near_miss.candidates(ids, clusters, m, fns, Config(tolerance_k=1.5))
    # the cluster is perfect: bar = .75 + 4/9 * .25
    score = (0.8 + 1 + 0.75) / 3
    assert found.count() == (score >= 0.75 + 4 / 9 * 0.25)
    found = near_miss.candidates(ids, clusters, m, fns, Config(identify_threshold=0.7, tolerance_k=10.0, tolerance_shrink_k=1e9))
    x = found.first()
    assert x["arith_score"] == pytest.approx(score) and x["rank"] == 1 and x["seq_score"] == pytest.approx(0.8)
    every = near_miss.candidates(ids, clusters, m, fns, Config(identify_threshold=0.6, tolerance_shrink_k=1e9))
    assert every.first()["arith_score"] == pytest.approx(score)  # without blocking by calls
    d = deltas.deltas(found, clusters, fns).first()
    assert d["tokens_added"] == ["ASSIGN"] and d["tokens_removed"] == ["RETURN"] and d["calls_added"] == ["w"] and d["imports_added"] == [] == d["calls_removed"]
    gone = deltas.deltas(found, clusters.where("false"), fns).first()
    assert gone["tokens_added"] == gone["calls_removed"] == [] and deltas.deltas(found, clusters.where("false"), fns, "inner").count() == 0
    o = deltas.outliers(found, clusters, fns).first()
    assert o["func"] == "f4" and o["candidates"][0]["size"] == 4 and o["token_delta"]["added"] == ["ASSIGN"]
    g = deltas.outlier_groups(found, clusters, fns).first()
    assert g["cluster_id"] == g["cluster_hash"][:6] and len(g["outliers"]) == 1
    assert deltas.potentials(found, fns).first()["potentials"] == ["f4#a.go#4"]
    e = deltas.export(found, clusters, m, fns, repo="r", min_score=1.1).first()
    assert e["corpus_size"] == 5 and e["unclustered_count"] == 1 and e["clusters"] == [] and len(e["orphans"]) == 1
    assert len(deltas.export(found, clusters, m, fns).first()["clusters"][0]["members"]) == 4
    shape = clusters.first()["shape_hash"]
    assert len(deltas.cluster_shape(shape, clusters, m, fns).first()["members"]) == 4 and deltas.cluster_shape(shape[:6], clusters, m, fns).count() == 0
    assert {r["label"]: r["count"] for r in report.delta_direction(deltas.deltas(found, clusters, fns)).collect()} == {"missing": 0, "extends": 0, "mixed": 1}
    assert [tuple(r) for r in report.missing_tokens(deltas.deltas(found, clusters, fns)).collect()] == [("RETURN", 1, 100)]
    cover = report.package_coverage(m, found, fns).collect()
    assert [tuple(r) for r in cover] == [("p", 4, 1, 5, 80, 20)]
    assert report.cluster_rows(clusters, m, fns, found).first()["potentials"] == ["f4#a.go#4"]


def test_blocking_by_calls_loses_nothing(spark):
    r = random.Random(8)
    rows = [(SEQ, ["a"], r.sample([f"c{k}" for k in range(8)], r.randrange(1, 6))) for _ in range(40)]
    fns = corpus(spark, rows, 40)
    m = spark.createDataFrame([(i % 5, i, i // 5) for i in range(25)], "cluster_id long, fn_id long, member_pos int")
    clusters, ids = P.assemble(m, fns), spark.createDataFrame([(i,) for i in range(25, 40)], "fn_id long")
    cfg = Config(tolerance_shrink_k=1e9)
    got = {(x["fn_id"], x["cluster_id"]) for x in near_miss.candidates(ids, clusters, m, fns, cfg).collect()}
    jac = lambda a, b: len({*a} & {*b}) / len({*a} | {*b})
    want = set()
    for i in range(25, 40):
        for c in range(5):
            s = [(1 + jac(rows[i][1], rows[j][1]) + jac(rows[i][2], rows[j][2])) / 3 for j in range(c, 25, 5)]
            if sum(s) / len(s) >= 0.75:
                want.add((i, c))
    assert got == want and 0 < len(want) < 75


def test_verdicts_on_histograms(spark):
    h = lambda *c: spark.createDataFrame([(i, n) for i, n in enumerate(c)], "bucket int, count long")
    sizes = [report.explain_sizes(h(*c)).first()["verdict"] for c in ((0, 0, 0), (9, 9, 5), (4, 3, 1), (6, 2, 0), (6, 2, 2))]
    assert sizes == ["none", "idioms", "healthy", "local", "mixed"]
    scores = [report.explain_scores(h(*c)).first()["verdict"] for c in ((3, 3, 4, 0, 6), (1, 1, 1, 3, 4), (5, 5, 5, 1, 1), (5, 4, 3, 2, 1), (1, 3, 2, 4, 1))]
    assert scores == ["bimodal", "clones", "conventions", "conventions", "spread"]


def test_export_of_no_clusters_has_nulls(spark, tmp_path):
    d = spark.createDataFrame([(i, 1, "click", 1.0) for i in range(9)], "event_id long, user_id long, event_type string, value double")
    d.select("*", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id")).alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    assert tuple(catalogue.export(spark, str(tmp_path)).first()) == ("events", "", 0, 0, None, None)
