import random

from priorview.llm import licenses as li

SCHEMA = "doc_id long, text string, license string, contained int"


def fixture():
    rng = random.Random(8)
    filler = ["w%d" % k for k in range(400)] + ["the", "of", "license", "under", "software", "version"] * 20
    rows, want = [], set()
    for k in range(300):
        w = rng.choices(filler, k=rng.randint(0, 200))
        if k % 2:
            name, text = rng.choice(li.TEMPLATES)
            t = text.split()
            if len(t) > 30:  # one word changed: five shingles of over 26
                t[rng.randrange(len(t))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = t
            want.add((k, name))
        rows.append((k, " ".join(w).upper() if k % 3 == 0 else "\n".join(w)))
    long = " ".join(rng.choices(filler, k=40_000))
    rows += [(400, None), (401, ""), (402, "mit"), (403, f"{long} {li.TEMPLATES[0][1]} {long}"), rows[1], (None, li.TEMPLATES[2][1])]
    want |= {(403, "Apache-2.0"), (None, "MIT")}
    return rows, want


def test_planted_and_verified(spark):
    rows, want = fixture()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = li.scan_licenses(docs).collect()
    pairs = {(r.id, r.license) for r in got}
    assert want <= pairs
    texts = dict(rows)
    for r in got:
        held = li.shingles(li.words(texts[r.id])[r.first_word:r.end_word])
        share = max(len(s & held) / len(s) for n, t in li.TEMPLATES if n == r.license for s in [li.shingles(li.words(t))])
        assert share >= 0.8 and abs(share - r.contained) < 1e-9
    # Whatever else is found holds it in truth.
    for i, name in pairs - want:
        own = li.shingles(li.words(texts[i]))
        assert any(len(s & own) >= 0.8 * len(s) for n, t in li.TEMPLATES if n == name for s in [li.shingles(li.words(t))])
    assert len([r for r in got if r.id == 1]) == 2 * len({p for p in pairs if p[0] == 1})


def test_windows_reach_every_place():
    index = li.Templates(li.TEMPLATES)
    for k, (name, text) in enumerate(li.TEMPLATES):
        found = [bool([1 for x in index.scan(["x y z " * (n // 3) + "q " * (n % 3) + text + " x y z" * 40]) if x[1] == name])
                 for n in range(0, 90)]
        assert all(found), (k, found)


def test_empty_and_no_templates(spark):
    docs = spark.createDataFrame([(1, li.TEMPLATES[0][1], "", 1)], SCHEMA)
    assert li.scan_licenses(docs.where("false")).count() == 0
    assert li.scan_licenses(docs, templates=[]).count() == 0
    assert li.scan_licenses(docs, templates=[("short", "three words only")]).count() == 0
