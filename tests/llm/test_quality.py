import random
import re
from collections import Counter
from math import comb

import pytest

import __spark_entry__ as entry
from oracle import compare, duck
from priorview.llm import quality as q

SCHEMA = "doc_id long, text string, lang string, id string, n_words int, m_low string, stratum string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines, seen, again = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        again += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered), len(lines)


def texts():
    rng = random.Random(8)
    out = [None, "", " \t\n\x0b\x0c\r ", "a", "a b", "a b c", "a a a a", "a b c a b c", "a b a b a b a", "x\n x\nx\n\nx\t\n", "# | <é> % b c",
           "long " * 40_000, "日本 語\x1f字\x1c a"]
    for _ in range(80):
        words = rng.choices("abcdefgh", k=rng.randint(1, 60)) if rng.random() < 0.5 else [f"w{rng.randrange(500)}" for _ in range(rng.randint(1, 200))]
        out.append("".join(w + rng.choice([" ", " ", "  ", "\n", "\t", "\x0c"]) for w in words))
    return out


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", 1, "y", "z") for i, t, g in rows], SCHEMA)


def test_measures(spark):
    rows = [(k, t, "en") for k, t in enumerate(texts())]
    rows += rows[3:6]
    got = q.measured(docs(spark, rows), "doc_id", "lang").collect()
    assert sorted((r.doc_id, *(r[m] for m in q.MEASURES)) for r in got) == sorted((i, *slow(t)) for i, t, _ in rows)
    assert q.measured(docs(spark, []), "doc_id").count() == 0
    with pytest.raises(ValueError):
        q.measured(docs(spark, []), "n_words")


def test_exact_binomial_bound(spark):
    cases = [(n, risk, error) for n in (0, 1, 10, 59, 300, 2000, 60_000) for risk, error in ((0.05, 0.05), (0.01, 0.0025))]
    for risk, error in ((0.05, 0.05), (0.01, 0.0025)):
        frame = spark.createDataFrame([(str(n), n) for n, r, _ in cases if r == risk], "stratum string, n long")
        got = {r.stratum: r.allowed for r in q.most_failures(frame, risk, error).collect()}
        for n in (0, 1, 10, 59, 300, 2000):
            below, best = 0.0, None
            for k in range(n + 1):
                below += comb(n, k) * risk ** k * (1 - risk) ** (n - k)
                if below > error:
                    break
                best = k
            assert got.get(str(n)) == best, (n, risk)
        assert 0.85 * 60_000 * risk < got["60000"] < 60_000 * risk


def corpus(rng, n):
    """Good and bad rows of two strata; what is usual in the second would be bad in the first."""
    rows, labels = [], []
    for i in range(n):
        good, lang = rng.random() < 0.8, rng.choice(["en", "xx", None])
        size = rng.randint(50, 70)
        words = [f"w{rng.randrange(10_000)}" + ("#" if rng.random() < (0.5 if lang == "xx" or not good else 0.01) else "") for _ in range(size)]
        if not good and lang == "xx":
            words = [w * 3 for w in words]
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(good)))
    return rows, labels


def test_limited_rejection_in_every_stratum(spark):
    rng = random.Random(9)
    rows, labels = corpus(rng, 6000)
    known = spark.createDataFrame(labels[:4500] + [(0, None), (999_999, 1), (None, 1)], "doc_id long, quality int")
    got = q.judged(docs(spark, rows + [(None, rows[0][1], "en")]), known).collect()
    good = dict(labels)
    for lang in ("en", "xx", None):
        own = [r for r in got if r.stratum == lang and r.id is not None and not r.base_failed]
        fine = [r for r in own if good[r.id]]
        assert sum(not r.kept for r in fine) <= 0.05 * len(fine)
        bad = [r for r in own if not good[r.id]]
        assert sum(not r.kept for r in bad) > 0.9 * len(bad)
    assert len(got) == 6001


def test_no_labels_and_few_labels_reject_nothing_more(spark):
    rows, labels = corpus(random.Random(10), 200)
    for known in ([], labels):
        frame = spark.createDataFrame(known, "doc_id long, quality int")
        assert all(r.kept == (not r.base_failed) for r in q.judged(docs(spark, rows), frame).collect())
    assert q.judged(docs(spark, []), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def test_texts_without_words_beside_cutoffs(spark):
    rows, labels = corpus(random.Random(11), 4000)
    bare = [(10_000 + i, t, lang) for i, (t, lang) in enumerate((t, lang) for t in (None, "", " \t\n ") for lang in ("en", "xx", None, "yy"))]
    known = spark.createDataFrame(labels + [(i, i % 2) for i, _, _ in bare], "doc_id long, quality int")
    got = {r.id: r for r in q.judged(docs(spark, rows + bare), known).collect()}
    assert all(got[i].base_failed and not got[i].kept and got[i].n_words == 0 for i, _, _ in bare)
    assert any(not r.base_failed and not r.kept for r in got.values())  # a cutoff was there


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    df = entry.queries()["op13_quality_rules"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert compare(df, duck(sf), q.OP13_SQL) == ""
