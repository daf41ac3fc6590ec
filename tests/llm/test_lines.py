import random

from priorview.llm import lines

SCHEMA = "doc_id long, text string, key string, pos int, H1 long"


def slow(rows):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))

    last = (1 << 63) - 1
    owner = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            owner[key(line)] = min(owner.get(key(line), last), last if i is None else i)
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if len(key(x)) < 10 or owner[key(x)] == (last if i is None else i)]
        out.append((i, "\n".join(kept), len(parts), len(parts) - len(kept)))
    return sorted(out, key=str)


def run(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, "k", 3, 4) for i, t in rows], SCHEMA)
    got = lines.dedup_lines(docs, **how)
    assert got.columns == docs.columns + ["n_lines", "n_dropped"]
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(1)
    pool = ["line number %d of the pool" % k for k in range(60)] + [
        "  Padded Line Here\t", "padded line here", "Éléphant rouge", "éléphant rouge", "short", "", "123456789", "1234567890",
        " padded line here", "MIXED case İ line", "mixed CASE İ LINE", "carriage return\r", "carriage return"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 9)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (None, "\n".join(pool)), (None, "a line only in null id\na line only in null id"),
             (5, "another text of the same id\n" + pool[3]), (203, "\n".join(pool * 300)), (204, "x" * 300_000 + "\ny")]
    rows += rows[:4]
    rng.shuffle(rows)
    for how in ({}, {"batches": 1}, {"batches": 7, "fanout": 2}):
        assert run(spark, rows, **how) == slow(rows)


def test_empty_and_all_null(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None)]) == [(None, "", 1, 0)]
