import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from priorview.llm import simhash
from priorview.llm.components import connected

SCHEMA = "doc_id long, text string, id string, fp string, component int"


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps, radius):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for k, i in enumerate(ids):
        r = find(k)
        low[r] = min([x for x in (low.get(r), i) if x is not None], default=None)
    return [low[find(k)] for k in range(len(ids))]


def texts():
    rng = random.Random(3)
    words = ["w%d" % k for k in range(50)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)]
    rows = list(base)
    for t in base[:30]:
        w = t.split()
        w[rng.randrange(len(w))] = "x"
        rows += [" ".join(w), t.upper(), t.replace(" ", " \t\n")]
    return rows + ["", None, " \r\n", "a b É", "long " * 70_000]


def check(spark, tile, agree):
    rows = [(k if k != 7 else None, t) for k, t in enumerate(texts())]
    rows += rows[3:6]  # repeated rows
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA)
    got = simhash.near_duplicates(docs, tile=tile, agree=agree)
    fps = [slow_fingerprint(t) for _, t in rows]
    comps = slow_components([i for i, _ in rows], fps, 4)
    want = sorted(((i, f - (1 << 64) if f >> 63 else f, c) for (i, _), f, c in zip(rows, fps, comps)), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_against_brute_force(spark):
    check(spark, 2048, 1)


def test_tiles_and_more_blocks(spark):
    check(spark, 2, 2)


def test_dense_and_chained_links(spark):
    rng = random.Random(5)
    fps, cur = {0, -1}, 0
    for _ in range(300):  # a chain of near fingerprints
        cur ^= 1 << rng.randrange(60)
        fps.add(cur)
    fps = sorted(fps)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = slow_components(fps, [f & (1 << 64) - 1 for f in fps], 4)
    for tile in (16, 2048):
        roots = {r.node: r.root for r in connected(simhash.links(frame, tile=tile)).collect()}
        assert [roots.get(f, f) for f in fps] == want


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_path(spark):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.root for r in connected(edges).collect()} == {0}


def test_pruned_pairs_are_all_pairs():
    rng = np.random.default_rng(1)
    a = rng.integers(-2**63, 2**63 - 1, 500)
    b = np.concatenate([a[:200] ^ (1 << rng.integers(0, 60, 200)), rng.integers(-2**63, 2**63 - 1, 300)])
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if int(np.bitwise_count(x ^ y)) <= 4}
    i, j = simhash._close(a, b, 4)
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want) >= 200


def test_one_document_of_each_group_stays(spark):
    schema = "doc_id long, text string, near_key string, near_id int, fp int"
    rows = [(k if k % 9 else None, t) for k, t in enumerate(texts())]
    rows += rows[3:6] + [(900 + k, rows[1][1]) for k in range(300)] + [(None, "alone, without an id")] * 3
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], schema)
    fps = [slow_fingerprint(t) for _, t in rows]
    groups = slow_components(list(range(len(rows))), fps, 4)
    best = {}
    for g, (i, t) in zip(groups, rows):
        own = (i is None, i or 0, hashlib.md5((t or "").encode()).hexdigest())
        best[g] = min(best.get(g, own), own)
    got = simhash.without_near_duplicates(docs)
    assert got.columns == docs.columns
    rows_out = got.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, hashlib.md5((r.text or "").encode()).hexdigest()) for r in rows_out) == sorted(best.values())
    assert {(r.near_key, r.near_id, r.fp) for r in rows_out} == {("x", 1, 2)}
    assert simhash.without_near_duplicates(docs.where("false")).count() == 0
