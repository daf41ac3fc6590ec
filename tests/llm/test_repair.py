import hashlib
import random

import pytest

import __spark_entry__ as entry
from oracle import compare, duck
from priorview.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, seq int, fault string, conv int"
INITIALS = {"user": "u", "assistant": "a", "system": "s"}


def legal(roles):
    rest = roles[1:] if roles[:1] == ["system"] else roles
    return not roles or bool(rest) and len(rest) % 2 == 0 and all(r == ("user", "assistant")[k % 2] for k, r in enumerate(rest))


def every_edit(rows):
    """All ways to edit rows of (role, text, fault), with up to two inserts in a place."""
    def go(k, cost, audit, out, inserts):
        if cost > 40:
            return
        if inserts < 2:
            for role in ("user", "assistant"):
                yield from go(k, cost + 5, audit + "I", out + [(role, "")], inserts + 1)
        if k == len(rows):
            if legal([r for r, _ in out]):
                yield cost, audit, out
            return
        role, text, fault = rows[k]
        yield from go(k + 1, cost + 2, audit + "D", out, 0)
        if fault not in ("blank", "duplicate"):
            more = 5 if fault == "truncated" else 0
            yield from go(k + 1, cost + more, audit + "K", out + [(role, text)], 0)
            for new in ("user", "assistant"):
                yield from go(k + 1, cost + 1 + more, audit + "R", out + [(new, text)], 0)
    return min(go(0, 0, "", [], 0), key=lambda x: x[:2])


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        bare = text.strip(repair.BLANK_CHARS)
        out.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    return out


def test_against_every_edit(spark):
    rng = random.Random(6)
    convs = {}
    for c in range(120):
        convs[c] = [(rng.choice(["user", "assistant", "system", "tool", "", "user"]), rng.choice(["a.", "b", " \t", "c!\n", "d.", "e?"]))
                    for _ in range(rng.randint(1, 4))]
    convs[None] = [("system", "x."), ("user", "y."), ("assistant", "z.")]
    rows = [(c, t, r, x, 1, "n", 2) for c, own in convs.items() for t, (r, x) in enumerate(own)]
    edits = repair.repairs(repair.with_faults(spark.createDataFrame(rows, SCHEMA)))
    got = {r.conv: r for r in repair.repair_report(edits).collect()}
    assert set(got) == set(convs)
    for c, own in convs.items():
        own = faults(own)
        cost, audit, out = every_edit(own)
        assert (got[c].cost, got[c].audit) == (cost, audit), own
        assert got[c].repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        assert [got[c][f] for f in ("blank", "duplicate", "truncated")] == [sum(f == x for *_, x in own) for f in ("blank", "duplicate", "truncated")]


def whole_strings(initials, fault=None):
    """The same search with every survivor's whole string."""
    best = {0: (0, "")}

    def insert(best):
        for state, sources in ((2, (0, 1, 3)), (3, (2,))):
            for s in sources:
                if s in best:
                    own = best[s][0] + 5, best[s][1] + "I"
                    best[state] = min(best.get(state, own), own)
        return best
    best = insert(best)
    for i in initials:
        new = {}
        for s, (c, a) in best.items():
            ways = [(s, c + 2, a + "D"), (repair.GIVEN[s], c + 1, a + "R")]
            if (s, i) in repair.KEPT:
                ways.append((repair.KEPT[s, i], c, a + "K"))
            for t, c2, a2 in ways:
                new[t] = min(new.get(t, (c2, a2)), (c2, a2))
        best = insert(new)
    return min(best[s] for s in (0, 3) if s in best)


@pytest.mark.parametrize("letters", ["uas", "x", "ux", "sa", "uuaa"])
def test_long_ties_and_bounded_memory(letters):
    rng = random.Random(letters)
    for _ in range(40):
        initials = rng.choices(letters, k=rng.randint(0, 60))
        search = repair.Search()
        said = "".join(e for i in initials for e in search.row(i, None)) + "".join(search.end())
        assert said == whole_strings(initials)[1]


def test_memory_follows_the_open_edits():
    for letters in ("uuasa", "ua", "suaau", "uaxua"):
        search, open_rows, most = repair.Search(), 0, 0
        for k in range(20_000):
            open_rows += 1 - sum(e != "I" for e in search.row(letters[k % len(letters)], None))
            most = max(most, open_rows)
        assert most < 50 and len(search.tree.parent) < 500, letters


def test_open_rows_go_to_a_file(monkeypatch):
    monkeypatch.setattr(repair, "IN_MEMORY", 300)
    rows, out = repair.Rows(), []
    for k in range(50):
        rows.put((k, "user", "x" * k, None))
        if k % 3 == 0:
            out.append(rows.get()[0])
    while rows.near or rows.held:
        out.append(rows.get()[0])
    assert out == list(range(50)) and rows.far is None


def test_cases(spark):
    rows = [(1, None, None, None, 1, "n", 2), (1, 3, "user", "a.", 1, "n", 2), (1, 5, "assistant", "b.", 1, "n", 2), (1, 5, "assistant", "b.", 1, "n", 2),
            (2, None, "user", "x.", 1, "n", 2), (2, None, "assistant", "y.", 1, "n", 2)]
    rows += [(3, t, "user" if t % 2 == 0 else "assistant", f"{t}." * 50_000 if t == 7 else f"{t}.", 1, "n", 2) for t in range(4000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv: r for r in repair.repair_report(repair.repairs(repair.with_faults(docs))).collect()}
    assert got[1][1:8] == (1, 1, 1, 0, 2, 4, "DKKD")
    assert got[2].audit == "RR"
    assert got[3].audit == "K" * 4000 and got[3].gaps == 0
    none = repair.repair_report(repair.repairs(repair.with_faults(docs.where("false"))))
    assert none.count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(entry.queries()["op12_conversation_repair"](spark, sf), duck(sf), repair.OP12_SQL) == ""
