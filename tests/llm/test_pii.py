import random
import re

from priorview.llm import pii

SCHEMA = "doc_id long, text string, spans string, term int"
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    values = [int(c) for c in digits][::-1]
    return sum(v if k % 2 == 0 else sum(divmod(2 * v, 10)) for k, v in enumerate(values)) % 10 == 0


def slow(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) < 256 for p in m[0].split("."))
                    or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15):
                out.append((kind, *m.span()))
    return out


def test_base_spans_against_the_patterns():
    rng = random.Random(1)
    alphabet = ["@", ".", "a", "B", "7", "12", "255", "256", "+", "-", " ", "(", ")", "é", "\n", "x.com", "4111 1111 1111 1111",
                "me@ex.org", "1.2.3.4", "+1 (555) 123-4567", "0"]
    for _ in range(4000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
        assert pii.base_spans(text) == slow(text), text


def test_long_runs_are_linear():
    for text in ("a" * 10**6, "1" * 10**6, "1." * 500_000, "@" * 10**6, "a@" * 500_000, "+1" * 500_000, "0" * 10**5 + ".1.1.1",
                 "a@b.c," * 100_000):
        pii.base_spans(text)
        list(pii._contexts(text[:60_000], 8))


def corpus():
    filler = "the of and to in that was it for on with as his they be at one have this from".split()
    rng = random.Random(3)
    rows = []
    for k in range(40):
        words = rng.choices(filler, k=30)
        if k % 4 == 0:  # a name that stands only beside one address
            words[10:12] = ["Zebulon,", "zeb@mail.example.org"]
        else:
            words[10:11] = [f"user{k}@mail.example.org"]
        rows.append((k, " ".join(words)))
    return rows


def test_terms(spark):
    rows = corpus() + [(None, None), (50, ""), (51, "zebulon x"), (51, "zebulon x"), (52, "pad " * 50_000)]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], SCHEMA)
    terms = {r.term: r.disclosure for r in pii.revealing_terms(docs).collect()}
    assert set(terms) == {"zebulon"} and 0.7 < terms["zebulon"] < 1
    for block in (200_000, 1):
        frame = spark.createDataFrame([("zebulon", 0.95), ("this", 0.8)], "term string, disclosure double")
        got = pii.with_spans(docs, terms=frame, block=block).collect()
        assert len(got) == len(rows)
        for r in got:
            words = [(m.start(), m.end()) for m in re.finditer("(?i)zebulon", r.text)]
            assert [(s.start, s.end) for s in r.spans if s.kind == "remove"] == words
            assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in PATTERNS] == slow(r.text)
    clean = {r.id: r.text for r in pii.sanitised(docs, terms=frame).collect()}
    assert clean[51] == " x" and "zeb@" not in clean[0] and "[EMAIL]" in clean[0] and clean[None] == ""


def test_empty(spark):
    assert pii.with_spans(spark.createDataFrame([], SCHEMA)).count() == 0


def test_eight_whole_words_however_long():
    far = ["%s%d" % ("x" * 150, k) for k in range(20)]
    text = " ".join(far[:10] + ["a.b@example.com"] + far[10:])
    assert {t for _, t, _ in pii._contexts(text, 8) if t} == set(far[2:18])
