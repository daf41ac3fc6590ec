import hashlib
import random

import pytest

from priorview.llm import chunks

SCHEMA = "doc_id long, text string, id int, part string, tail string"


def slow_chunks(data, least, usual, most):
    hard, soft = (int(m) for m in chunks._masks(least, usual))
    out, start, h = [], 0, 0
    for k, b in enumerate(data):
        h = (2 * h + int(chunks.GEAR[b])) % (1 << 32)
        n = k + 1 - start
        if n >= most or k + 1 == len(data) or n >= least and not h & (hard if n < usual else soft):
            out.append((start, k + 1))
            start = k + 1
    return out


@pytest.mark.parametrize("sizes", [(32, 96, 384), (4, 16, 40)])
def test_boundaries(sizes):
    rng = random.Random(1)
    for n in (0, 1, 31, 32, 33, 500, 20_000):
        data = bytes(rng.choices(b"abcdefgh \n", k=n))
        assert chunks.chunks(data, *sizes) == slow_chunks(data, *sizes)


def test_an_insertion_moves_few_chunks():
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(3000))
    moved = "inserted words " + text[:9000] + "more" + text[9000:]
    assert chunks.containment(chunks.digests(text), chunks.digests(moved)) > 0.95
    other = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(3000))
    assert chunks.containment(chunks.digests(text), chunks.digests(other)) < 0.02


def slow_rows(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    out = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]
        a, b, c = map(chunks.digests, (t, e, nxt))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), chunks.to_text(a), chunks.to_text(b),
                    chunks.containment(a, b), chunks.containment(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_against_brute_force(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.randrange(500) * 3 - 200, " ".join(rng.choices(["wörd", "two", "thrée", "and"], k=rng.randint(0, 200)))) for _ in range(60)]
    rows += [(None, "no id"), (None, None), (7, None), (8, ""), (9, "end " * 60_000)] + rows[:3]
    docs = spark.createDataFrame([(i, t, 1, "p", "q") for i, t in rows], SCHEMA)
    assert sorted((tuple(r) for r in chunks.compare_next(docs, parts=parts).collect()), key=str) == slow_rows(rows)
    alone = {(r.id, r.fingerprint) for r in chunks.fingerprints(docs).collect()}
    assert alone == {(r[0], r[3]) for r in slow_rows(rows)}


def test_one_row_and_none(spark):
    assert chunks.compare_next(spark.createDataFrame([], SCHEMA)).count() == 0
    assert len(chunks.compare_next(spark.createDataFrame([(1, "abc", 1, "", "")], SCHEMA)).collect()) == 1
