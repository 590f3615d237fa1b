import random
import re
from collections import Counter, defaultdict
from itertools import combinations

from simlattice.llm import packing as P


def test_fullest_against_all_subsets():
    r = random.Random(1)
    for _ in range(120):
        lengths = [r.randrange(1, 30) for _ in range(r.randrange(1, 9))]
        capacity = 30
        chosen = P.fullest(Counter(lengths), capacity)
        first, rest = max(lengths), sorted(lengths, reverse=True)[1:]
        best = max(first + sum(c) for k in range(len(rest) + 1) for c in combinations(rest, k) if first + sum(c) <= capacity)
        assert sum(x * k for x, k in chosen) == best and not Counter(dict(chosen)) - Counter(lengths) and dict(chosen)[first] >= 1


def windows(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["window"]].append((r["window_from"], r["doc_id"], r["doc_from"], r["doc_to"]))
    return out


def check(docs, capacity):
    got = windows(P.pack(docs, capacity=capacity))
    for pieces in got.values():  # no gap, no overlap, no overflow
        at = 0
        for start, _, a, b in sorted(pieces, key=lambda p: p[0]):
            assert start == at
            at += b - a
        assert at <= capacity
    have = Counter((i, a, b) for pieces in got.values() for _, i, a, b in pieces)
    want = Counter()
    for r in docs.collect():
        n = len(re.findall("[^ \t\n\r]+", r["text"] or ""))
        want.update((r["doc_id"], a, min(n, a + capacity)) for a in range(0, n, capacity))
    assert have == want and sorted(got) == list(range(len(got)))
    return got


def test_every_token_once(spark, docs, sf):
    for d, c in ((docs, 2048), (docs, 10), (spark.read.parquet(f"{sf}/documents.parquet"), 512), (spark.read.parquet(f"{sf}/documents.parquet"), 2048)):
        got = check(d, c)
        tokens = sum(b - a for p in got.values() for _, _, a, b in p)
        assert len(got) <= tokens / c * 1.02 + 2


def test_as_full_as_one_window_after_the_other():
    r = random.Random(4)
    counts = Counter(r.randrange(1, 100) for _ in range(600))
    rows, left, windows_ = P.plan(dict(counts), 100), Counter(counts), []
    while left:  # without using a multiset several times at once
        chosen = P.fullest(dict(left), 100)
        left -= Counter(dict(chosen))
        windows_.append(sum(x * k for x, k in chosen))
    n = max(first + (hi - lo) // k for _, lo, hi, k, first, _ in rows)
    assert n == len(windows_)


def test_cases(spark, empty, clashing, docs):
    assert P.pack(empty).count() == 0
    assert sorted(map(str, P.pack(clashing).collect())) == sorted(map(str, P.pack(docs).collect()))
