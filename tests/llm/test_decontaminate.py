import random
import re
import time

import numpy as np

from priorview.llm import decontaminate as d

DOCS = "doc_id long, text string, item long, start string, item_id int"
ITEMS = "item_id long, text string, doc_id int"


def slow_distance(item, text):
    row = [0] * (len(text) + 1)
    for x in item:
        new = [row[0] + 1]
        for k, y in enumerate(text):
            new.append(min(row[k] + (x != y), row[k + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def fixture():
    rng = random.Random(6)
    vocabulary = ["w%d" % k for k in range(120)] + ["the", "of", "and", "to"] * 10
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(12, 40)))) for k in range(30)]
    items += [(90, "the of and"), (91, None), (92, ""), (93, items[0][1])]
    docs = []
    for k in range(150):
        w = rng.choices(vocabulary, k=rng.randint(0, 120))
        if k % 3:
            passage = rng.choice(items[:30])[1].split()
            edits = int(0.2 * len(passage)) if k % 3 == 1 else rng.choice([0, 0, 1, int(0.3 * len(passage)) + 2])
            for _ in range(edits):
                at = rng.randrange(len(passage))
                passage[at:at + rng.randint(0, 1)] = rng.choice([[], ["edited"], [rng.choice(vocabulary)]])
            at = rng.randint(0, len(w))
            w[at:at] = passage
        docs.append((k, " ".join(w).upper() if k % 5 == 0 else ", ".join(w)))
    docs += [(200, None), (201, ""), (None, items[3][1]), (202, "pad " * 30_000 + items[4][1] + " pad" * 30_000), docs[1], docs[1],
             (203, "İİ " + items[5][1])]
    return docs, items


def test_distance():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(lo, 12))] for lo in (1, 0))
        edits, end = d.distance(np.array(a, np.uint64), np.array(b, np.uint64))
        assert edits == slow_distance(a, b)
        assert min(slow_distance(a, b[:k]) for k in range(end + 1)) == edits


def test_against_brute_force(spark):
    docs, items = fixture()
    want, exact = set(), set()
    for i, t in docs:
        dw = re.findall(r"\w+", (t or "").lower()) if i != 203 else t[3:].split()
        for j, x in items:
            iw = (x or "").split()
            if i == 202 and j != 4:
                continue  # slow, and its padding is in no item
            if len(iw) >= 5 and (e := slow_distance(iw, dw)) <= int(0.2 * len(iw)):
                want.add((i, j, e))
                exact |= {(i, j)} if e == 0 else set()
    dd = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in docs], DOCS)
    ii = spark.createDataFrame([(i, t, 3) for i, t in items], ITEMS)
    for block in (20_000, 9):
        rows = d.passages(dd, ii, block=block).collect()
        got = {(r.id, r.item, r.edits) for r in rows}
        assert {g[:2] for g in got} <= {w[:2] for w in want}
        assert len({g[:2] for g in got}) >= 0.95 * len({w[:2] for w in want})
        assert exact <= {g[:2] for g in got if g[2] == 0}
        assert len(got & want) >= 0.95 * len(want)
        texts = dict(docs)
        for r in rows:
            if r.edits == 0:
                assert re.findall(r"\w+", texts[r.id][r.start:r.end].lower()) == dict(items)[r.item].split()
        kept = [r.doc_id for r in d.decontaminated(dd, ii, block=block).collect()]
        bad = {g[0] for g in got}
        assert sorted(kept, key=str) == sorted((i for i, _ in docs if i not in bad), key=str)


def test_empty(spark):
    docs, items = fixture()
    dd = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in docs], DOCS)
    ii = spark.createDataFrame([(i, t, 3) for i, t in items], ITEMS)
    assert d.passages(dd.where("false"), ii).count() == 0
    assert d.passages(dd, ii.where("false")).count() == 0
    assert d.decontaminated(dd, ii.where("false")).count() == len(docs)
    assert d.decontaminated(dd, ii).schema == dd.schema


def test_recall_of_each_class_at_the_largest_distance():
    rng = random.Random(8)
    items = [(k, " ".join("w%d" % rng.randrange(3000) for _ in range(n))) for k, n in enumerate([20] * 20 + [25] * 20 + [40] * 20 + [50] * 20)]
    index = d.Index(items)
    made = np.random.default_rng(99)
    for n in (20, 25, 40, 50):
        own = [k for k, x in enumerate(index.items) if len(x) == n]
        c = next(c for c in index.classes if any(np.isin(own, i).any() for i in c.items))
        w, picked = c.window, own * 40
        heads = np.concatenate([index.items[k][:w] for k in picked])
        copies = np.concatenate([d._edited(index.items[k], index.most[k], made)[:w] for k in picked])
        at = np.arange(len(picked)) * w
        found = np.zeros(len(picked), bool)
        for walk in c.walks:
            found |= d._walk(heads, at, w, *walk) == d._walk(copies, at, w, *walk)
        assert found.mean() >= 0.965, n


def test_walks_read_a_word_once():
    """The walk is the plain one, over windows up to the last word, at well under its work."""
    rng = np.random.default_rng(4)
    symbols, window = rng.integers(0, 900, 120_000).astype(np.uint64), 30
    starts = np.arange(len(symbols) - window + 1)
    mult = rng.integers(1, 1 << 63, 2 * window, np.uint64) * np.uint64(2) + np.uint64(1)
    steps = np.array([3, 17, 38, 51])

    def plain():
        pos, key = np.zeros(len(starts), np.int64), np.full(len(starts), np.uint64(0x9E3779B97F4A7C15), np.uint64)
        for step in range(52):
            here = np.where(pos < window, symbols[np.minimum(starts + pos, len(symbols) - 1)], np.uint64(d.PAD))
            if step in steps:
                key = (key ^ here) * np.uint64(0xD6E8FEB86659FD93)
                key ^= key >> np.uint64(32)
            pos += ((here + np.uint64(1)) * mult[step] >> np.uint64(63)).astype(np.int64)
        return key

    def seconds(run):
        times = []
        for _ in range(5):
            start = time.process_time()
            run()
            times.append(time.process_time() - start)
        return min(times)

    assert (d._walk(symbols, starts, window, mult, steps) == plain()).all()
    assert not len(d._walk(symbols, starts[:0], window, mult, steps))
    assert seconds(lambda: d._walk(symbols, starts, window, mult, steps)) < 0.8 * seconds(plain)
