import hashlib
import random

import numpy as np
from public_tokenizers import path

from priorview.llm import chat

FILE = path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, ids int, seq string"
PIECES = ["\\", "\\\\", "### User: ", "### Assistant:", "</turn>", "\n</turn>\n", "</role>", "### Role: ", "###", " ", "é", "日本", "<|endoftext|>",
          "\n", "word", "\U0001f600", "</turn", ">", "\x00", "### ", "User:"]


def random_text(rng):
    return "".join(rng.choices(PIECES, k=rng.randint(0, 12)))


def test_escapes_round_trip():
    rng = random.Random(1)
    for _ in range(20_000):
        t = random_text(rng)
        assert chat.unescape(chat.escape(t)) == t
    assert chat.escape("\\" * 300_000) == "\\" * 300_000


def test_template_round_trip():
    rng = random.Random(2)
    template = chat.Template(FILE)
    turns = [(rng.choice(["system", "user", "assistant", "tool", "", "critic", random_text(rng)]), random_text(rng)) for _ in range(400)]
    ids, loss, ends = template.encode(turns, ("assistant",))
    parts = np.split(ids, ends[:-1])
    read = template.read(parts)
    assert [(r, t) for r, t, _ in read] == turns
    text = template.written(ids)
    assert sum(n for *_, n in read) == len(text)
    assert chat.parse(text) == turns  # the text alone says the same
    learned = "".join(chat.unescape(x) for x in template.decode([p[m].tolist() for p, m in zip(parts, np.split(loss, ends[:-1]))]))
    assert learned == "".join(t for r, t in turns if r == "assistant")
    assert not (ids[loss] >= template.base).any()
    assert template.encode([], ())[0].size == 0


def test_digests(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd", None]), random_text(rng)) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(100, t, "assistant", f"turn {t}") for t in range(3000)]  # one long conversation
    rows += [(None, 0, "user", "a"), (None, None, "assistant", "first"), (101, 0, "assistant", None), (102, 0, "user", ""),
             (103, 1, "assistant", "long " * 60_000), (102, 0, "user", "")]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, 1, "s") for r in rows], SCHEMA)
    turns = chat.format_turns(frame, FILE)
    got = {r.conv: r for r in chat.digests(turns, FILE).collect()}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, own in want.items():
        r = got[c]
        learned = "".join(t for role, t in own if role == "assistant")
        assert r.n_turns == len(own) and r.loss_chars == len(learned)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        full = [chat.HEADERS.get(a, f"{chat.OTHER}{chat.escape(a)}{chat.OTHER_END}") + chat.escape(b) + chat.END for a, b in own]
        assert r.formatted_chars == sum(map(len, full))
    long = [r for r in turns.collect() if r.conv == 100]
    assert [r.seq for r in long] == list(range(3000)) == [r.turn for r in long]
    assert [r.start for r in long] == np.cumsum([0] + [len(r.ids) for r in long])[:-1].tolist()


def test_empty(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert chat.digests(chat.format_turns(frame, FILE), FILE).count() == 0
