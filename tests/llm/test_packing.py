import random
import zlib

import numpy as np
import pytest
from public_tokenizers import path

from priorview.llm import packing

SCHEMA = "doc_id long, text string, length string, sequence_id int, rank int"
FILE = path("word_bpe_49k.json")
ODD = ["İstanbul İ. x, İ", "é café, ́", "don't we'll I'm", "a b c​d", "<|endoftext|> x </w>", "!!, hello,. 12,3 ß ΣΑΣ ΟΔΟΣ.",
       "한국어 한, क़ क़.", "a\x1cb\x85c d!\x1f!", "", "word, word. Word,. Ärger, ÄRGER.", "one\n\ntwo\tthree"]


def test_ids_equal_the_whole_text():
    tok = packing.WordTokenizer(FILE, cache=40)
    rng = random.Random(2)
    texts = ODD + [" ".join("".join(rng.choices("abcé,.'1ßÑ", k=rng.randint(1, 7))) for _ in range(30)) for _ in range(300)]
    for t in texts + texts[::-1]:
        assert tok.ids(t).tolist() == tok.tok.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = random.Random(seed)
    limit = 64
    hist = {rng.randint(1, limit): rng.randint(1, 500) for _ in range(rng.randint(1, 64))}
    slots = packing.plan(hist, limit)
    begun = {}
    for s in slots.itertuples():
        for r in range(s.high - s.low):
            q, o = s.base + r // s.per, s.offset + r % s.per * s.length
            begun.setdefault(q, []).append((o, s.length))
    for length, n in hist.items():
        part = slots[slots.length == length].sort_values("low")
        assert part.low.iloc[0] == 0 and part.high.iloc[-1] == n and (part.low.iloc[1:].values == part.high.iloc[:-1].values).all()
    for items in begun.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= limit
    # No more sequences than best fit item by item.
    room = []
    for length in sorted(hist, reverse=True):
        for _ in range(hist[length]):
            fit = min((r for r in room if r >= length), default=None)
            if fit is None:
                room.append(limit - length)
            else:
                room[room.index(fit)] -= length
    assert len(begun) <= len(room)


def test_query_form(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choices(["alpha", "beta,", "Gamma.", "zürich"], k=rng.randint(0, 90)))) for k in range(150)]
    rows += [(None, "null id"), (900, None), (901, ""), (902, "word " * 500), (903, "same"), (903, "same")] + rows[:3]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    got = packing.packed_documents(docs, FILE, limit=64).collect()
    tok = packing.WordTokenizer(FILE)
    want = []
    for i, t in rows:
        ids = tok.ids(t or "").tolist() + [1]
        for k in range(0, len(ids), 64):
            part = np.array(ids[k:k + 64], "<u4").tobytes()
            want.append((i, k // 64, k, len(part) // 4, zlib.crc32(part)))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in places.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 64
    assert len(places) <= sum(w[3] for w in want) / 64 * 1.05 + 1


def test_empty(spark):
    assert packing.packed_documents(spark.createDataFrame([], SCHEMA), FILE).count() == 0
