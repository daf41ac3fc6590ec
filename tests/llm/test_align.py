import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from public_tokenizers import path
from tokenizers import Tokenizer

from priorview.llm import align as al

A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, id string, links int, a_ids string"


@pytest.fixture(scope="module")
def slow():
    """The rows of the contract, token by token."""
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    letters = al._byte_letters()

    def tokens(text):
        if not text:
            return [], []
        a = [(t, bytes(letters[c] for c in tok.id_to_token(t))) for t in tok.encode(" " + text, add_special_tokens=False).ids]
        b = [(t, bytes([int(sp.id_to_piece(t)[3:5], 16)]) if sp.is_byte(t) else sp.id_to_piece(t).replace("▁", " ").encode())
             for t in sp.encode(text)]
        raw = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else ([], [])

    def groups(a, b):
        out, own_a, own_b, end_a, end_b, a, b = [], [], [], 0, 0, list(a), list(b)
        while a or b:
            if end_a <= end_b:
                t, raw = a.pop(0)
                own_a.append(t)
                end_a += len(raw)
            else:
                t, raw = b.pop(0)
                own_b.append(t)
                end_b += len(raw)
            if end_a == end_b:
                out.append((own_a, own_b))
                own_a, own_b = [], []
        return out

    def run(rows):
        found = [(i, *tokens(t)) for i, t in rows]
        found = [(i, a, b, groups(a, b)) for i, a, b in found]
        links = [[(x[-1], y[-1]) for x, y in g] for *_, g in found]
        count = Counter(p for own in links for p in own)
        most = {}
        for (_, y), n in count.items():
            most[y] = max(most.get(y, 0), n)
        out = []
        for (i, a, b, g), own in zip(found, links):
            said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
            out.append((i, len(a), len(b), len(g), hashlib.sha256(said.encode()).hexdigest() if a else "", len(own),
                        sum(count[p] == most[p[1]] for p in own), sum(count[p] for p in own)))
        return out

    return run


def texts():
    rng = random.Random(4)
    words = "the straße naïve 日本語 über-all x = 12345 don't 🙂 é <s> </s> <unk> <|endoftext|> <0x41> \t \n\n   ▁ \x00 　 ﬁ Ⅷ".split(" ")
    rows = [" ".join(rng.choices(words[:-2] + [""], k=rng.randint(1, 80))) for _ in range(60)]
    return rows + [None, "", " ", "  ", "a", "\n", "▁", "a▁b", "<|endoftext|>", "<s>", "word " * 30_000, "é" * 5000, "x" * 4000] + rows[:3]


def got(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)
    linked = al.stored(al.with_links(docs, A, B), "align-test")
    return sorted((tuple(r) for r in al.scored(linked, A, B).collect()), key=str)


def test_against_single_tokens(spark, slow):
    rows = [(k if k != 5 else None, t) for k, t in enumerate(texts())]
    assert got(spark, rows) == sorted(slow(rows), key=str)


def test_small_lanes_and_chunks(spark, slow, monkeypatch):
    monkeypatch.setattr(al, "LANE", 7)
    rows = [(k, t) for k, t in enumerate(texts()) if len(t or "") < 3000]
    pair = al._pair(A, B)
    whole = al._aligned(pair, [t for _, t in rows])
    monkeypatch.setattr(al, "LANE", 1 << 20)
    for x, y in zip(whole, al._aligned(pair, [t for _, t in rows])):
        assert all(np.array_equal(p, q) for p, q in zip(x, y))


def test_special_strings_are_text(slow):
    assert slow([(1, "<s> <|endoftext|>")])[0][1] > 5


def test_every_character_has_the_ids_of_the_file():
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    fast = al._pair(A, B).a
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    lines = ["".join(f"a{c}1{c}!{c} {c}" for c in chars[k:k + 400]) for k in range(0, len(chars), 400)]
    for line, ids in zip(lines, fast.encode(lines)):
        assert tok.encode(" " + line, add_special_tokens=False).ids == ids.tolist()


def test_lockstep_against_sets():
    rng = np.random.default_rng(2)
    a, b = (np.unique(np.append(rng.integers(1, 5000, 1500), 5000)) for _ in range(2))
    for edges in ([0, 5000], [0, 1, 2, 700, 701, 4999, 5000], list(range(5001))):
        i, j = al.lockstep(a, b, np.array(edges))
        assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_empty(spark):
    assert got(spark, []) == []


def test_ids_and_cuts(spark):
    rows = [(k, t) for k, t in enumerate(texts()) if len(t or "") < 1000]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)
    pair, text, whole = al._pair(A, B), dict(rows), 0
    for r in al.align(docs, A, B).collect():
        assert len(r.a_cuts) == len(r.b_cuts) and bool(r.a_ids) == bool(r.b_ids) == bool(r.a_cuts)
        for x, y in zip(r.a_cuts, r.b_cuts):
            assert pair.a.joined(np.array(r.a_ids[:x])) == pair.b.joined(np.array(r.b_ids[:y]))
        if r.a_cuts:
            whole += 1
            assert pair.a.joined(np.array(r.a_ids)) == (" " + text[r.id]).encode() and r.a_cuts[-1] == len(r.a_ids)
    assert whole >= 20
