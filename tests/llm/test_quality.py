import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from simlattice.llm import quality, textstats


def test_distance_is_jensen_shannon():
    p, q = np.array([[1.0, 0, 3], [1, 1, 1], [0, 0, 0]]), np.array([[1.0, 0, 3], [0, 2, 1], [1, 2, 3]])

    def one(a, b):
        if not sum(a) or not sum(b):
            return 0.0
        a, b = [x / sum(a) for x in a], [x / sum(b) for x in b]
        kl = lambda u, m: sum(x * math.log2(x / y) for x, y in zip(u, m) if x)
        m = [(x + y) / 2 for x, y in zip(a, b)]
        return math.sqrt(max(0, (kl(a, m) + kl(b, m)) / 2))

    assert np.allclose(quality.distance(p, q), [one(a, b) for a, b in zip(p, q)])


def test_histograms_against_plain_counting():
    texts = ["The cat, the DOG! 12", "", "Äpfel und Öl — für", "the  the\nthe", "x" * 70_000]
    classes = textstats.class_counts(pa.array(texts, pa.large_string()))
    for t, row in zip(texts, classes):
        assert row.sum() == len(t)
        assert row[6] == sum(0xC0 <= ord(c) < 0x340 for c in t) and row[5] == sum(c in "—" for c in t)
        assert row[0] == sum("a" <= c <= "z" for c in t) and row[1] == sum("A" <= c <= "Z" for c in t) and row[2] == sum("0" <= c <= "9" for c in t)
    words = textstats.word_counts(textstats.words(pa.array(texts, pa.large_string())), ["en"] * 5)
    common = textstats.COMMON["en"].split()
    for t, row in zip(texts, words):
        w = t.lower().split()
        assert list(row) == [w.count(c) for c in common] + [sum(x not in common for x in w)]


def test_whole_table_against_brute_force(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows, ref = d.collect(), {}
    counted = {}
    for r in rows:
        a = pa.array([r["text"]], pa.large_string())
        counted[r["doc_id"]] = (textstats.class_counts(a)[0], textstats.word_counts(textstats.words(a), [r["lang"]])[0])
        c, w = ref.get(r["lang"], (0, 0))
        ref[r["lang"]] = (c + counted[r["doc_id"]][0], w + counted[r["doc_id"]][1])
    for r in quality.judge(d).collect():
        c, w = counted[r["doc_id"]]
        dc, dw = (float(quality.distance(x[None], y[None])[0]) for x, y in zip((c, w), ref[r["lang"]]))
        n = int(w.sum())
        bad_c, bad_w = n >= 30 and dc > 0.13 + 1.4 / n**0.5, n >= 60 and dw > 0.08 + 2.4 / n**0.5
        assert r["n_words"] == n and abs(r["char_distance"] - dc) < 1e-5 and abs(r["word_distance"] - dw) < 1e-5
        assert r["reason"] == ("empty" if not c.sum() else "characters" if bad_c else "words" if bad_w else "short" if n < 60 else "ok")


def test_good_documents_stay(spark, sf):
    """Held-out check: labels aren't used by the rules."""
    sf = "/root/testdata/sf0.01"
    d = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    kept = {r["quality"]: r["k"] for r in d.groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("k")).collect()}
    assert kept[1] > 0.98 and kept[0] < 0.7


def test_references_joined_or_sent(docs):
    a, b = [sorted(map(str, quality.judge(docs, max_references=n).collect())) for n in (0, 100)]
    assert a == b and len(a) == docs.count()


def test_cases(docs, empty, clashing):
    by = {(r["doc_id"], r["text"] is None): r for r in quality.judge(docs).collect()}
    assert by[(3, False)]["reason"] == by[(4, True)]["reason"] == by[(None, True)]["reason"] == "empty" and not by[(3, False)]["keep"]
    assert by[(5, False)]["reason"] == by[(6, False)]["reason"] == "short" and by[(6, False)]["keep"]
    assert by[(7, False)]["n_words"] == 30_000
    assert quality.judge(empty).count() == 0 and quality.keep_good(empty).columns == empty.columns
    j = quality.judge(clashing)
    assert [c.lower() for c in j.columns].count("keep") == 1 and j.count() == docs.count()
    assert quality.keep_good(clashing).columns == clashing.columns


def test_noise_is_rejected(spark):
    r = random.Random(1)
    words = [w for w in textstats.COMMON["en"].split() for _ in range(3)] + ["house", "garden", "river", "letter", "morning"] * 20
    prose = [(i, " ".join(r.choice(words) for _ in range(300)), "en") for i in range(40)]
    noise = [(100, "@@## %%%% &&&& " * 100, "en"), (101, "zxqv wrtp lkjh mnbv " * 80, "en")]
    got = {x["doc_id"]: x["keep"] for x in quality.judge(spark.createDataFrame(prose + noise, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] for i in range(40)) and not got[100] and not got[101]


WORDS = {"el": "και το του της να η με για από που στο είναι".split(), "ru": "и в не на что с как по это все она так".split()}


def _foreign(seed=3):
    r, rows = random.Random(seed), []
    for lang, common in WORDS.items():
        rest = ["".join(r.choice("αβγδεζηθλμν" if lang == "el" else "бвгдежзклмн") for _ in range(7)) for _ in range(3000)]
        rows += [(len(rows) + i, " ".join(r.choice(common) if r.random() < 0.45 else r.choice(rest) for _ in range(250)), lang) for i in range(60)]
    return rows


def test_common_words_are_learned(spark):
    rows = _foreign() + [(900, "the of and to " * 30, "en"), (901, "x y z " * 50, None), (902, "q w e " * 50, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["lang"]: r["common"] for r in quality.learned_words(d).collect()}
    assert set(got) == set(WORDS)
    for lang, common in WORDS.items():
        n = {}
        for _, text, l in rows:  # noqa: E741
            if l == lang:
                for w in text.split():
                    n[w] = n.get(w, 0) + 1
        total = sum(n.values())
        want = sorted((w for w in n if n[w] >= 0.005 * total), key=lambda w: (-n[w], np.array([textstats.hash_of(w)], np.uint64).view(np.int64)[0]))[:30]
        assert got[lang] == [int(np.array([textstats.hash_of(w)], np.uint64).view(np.int64)[0]) for w in want] and set(want) == set(common)


def test_other_languages_and_scripts_are_judged(spark):
    r, rows = random.Random(8), _foreign()
    salad = " ".join(r.choice(["αβγ", "δεζ", "ηθι", "κλμ"]) for _ in range(400))
    bad = [(500, salad, "el"), (501, " ".join(w for w in WORDS["ru"] * 30), "el"), (502, "漢字仮名交じり 文 " * 100, "ru")]
    d = spark.createDataFrame(rows + bad, "doc_id long, text string, lang string")
    got = {x["doc_id"]: (x["keep"], x["reason"]) for x in quality.judge(d).collect()}
    assert all(got[i][0] for i, _, _ in rows) and got[500] == (False, "words") and got[501] == (False, "words") and got[502] == (False, "characters")
    assert {x["doc_id"]: (x["keep"], x["reason"]) for x in quality.judge(d, max_references=0).collect()} == got
