"""Repair of conversation structure by a streamed Viterbi search with survivor coalescence."""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections import deque
from functools import cmp_to_key

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import table

# What stands at the end of the repaired rows so far: nothing, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
GIVEN = (USER, USER, ASSISTANT, USER)  # where a new or changed role leads from each state
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
# The costs of the edits, and of a truncated row that stays.
CHANGE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANK_CHARS = " \t\n\x0b\x0c\r"
FLUSH = 1 << 22     # characters of a batch of edits
IN_MEMORY = 1 << 26  # bytes of open rows before they go to a file


class Rows:
    """The rows of which the edit is still open, first in, first out; beyond IN_MEMORY bytes in a
    file that goes with the process."""

    def __init__(self):
        self.near, self.bytes, self.far, self.read, self.held = deque(), 0, None, 0, 0

    def put(self, row: tuple) -> None:
        if self.far is None and self.bytes < IN_MEMORY:
            self.near.append(row)
            self.bytes += 64 + len(row[2])
            return
        if self.far is None:
            self.far = tempfile.TemporaryFile()
        self.far.seek(0, 2)
        pickle.dump(row, self.far)
        self.held += 1

    def get(self) -> tuple:
        if self.near:
            row = self.near.popleft()
            self.bytes -= 64 + len(row[2])
            return row
        self.far.seek(self.read)
        row = pickle.load(self.far)
        self.read, self.held = self.far.tell(), self.held - 1
        if not self.held:
            self.close()
        return row

    def close(self) -> None:
        if self.far is not None:
            self.far.close()
        self.far, self.read, self.held = None, 0, 0


class Tree:
    """Back-pointers of the survivors with reference counts. A node is one edit. `lone` holds the
    exclusive-or of a node's children: its child, where it has one."""

    def __init__(self):
        self.parent, self.refs, self.lone, self.edit, self.free = array("q"), array("q"), array("q"), bytearray(), array("q")
        self.root = self.node(-1, "D")

    def node(self, parent: int, edit: str) -> int:
        if self.free:
            k = self.free.pop()
            self.parent[k], self.refs[k], self.lone[k], self.edit[k] = parent, 0, 0, ord(edit)
        else:
            k = len(self.parent)
            self.parent.append(parent)
            self.refs.append(0)
            self.lone.append(0)
            self.edit.append(ord(edit))
        if parent >= 0:
            self.refs[parent] += 1
            self.lone[parent] ^= k
        return k

    def hold(self, k: int) -> None:
        self.refs[k] += 1

    def drop(self, k: int) -> None:
        """Give up a hold; what nothing refers to any more is free."""
        self.refs[k] -= 1
        while not self.refs[k]:
            up = self.parent[k]
            self.free.append(k)
            self.refs[up] -= 1
            self.lone[up] ^= k
            k = up

    def settled(self, held: list[int]):
        """Edits that all survivors share and that were not given yet, in order."""
        while self.refs[self.root] == 1 and self.root not in held:
            child = self.lone[self.root]
            self.free.append(self.root)
            self.root = child
            yield chr(self.edit[child])


class Survivor:
    """The best path to a state: its cost, its node, its place among the survivors by the edits
    (ASCII), and where its last row edit came from, with the number of inserts after it. Two
    survivors' edits begin alike up to the shorter one's end only if they share that origin."""

    __slots__ = ("cost", "inserts", "node", "origin", "place")

    def __init__(self, cost: int, node: int, origin: tuple, inserts: int = 0, place: int = 0):
        self.cost, self.node, self.origin, self.inserts, self.place = cost, node, origin, inserts, place


def _before(p: tuple[int, str], q: tuple[int, str], old: list) -> bool:
    """Whether the edits p are less than q, each the state of an old survivor and what follows.
    This is the comparison of the complete open suffixes: of the old survivors' by their place,
    or, where one continues the other, of what follows."""
    if p[0] == q[0]:
        return p[1] < q[1]
    a, b = old[p[0]], old[q[0]]
    if a.origin == b.origin:
        n = min(a.inserts, b.inserts)
        return "I" * (a.inserts - n) + p[1] < "I" * (b.inserts - n) + q[1]
    return a.place < b.place


class Search:
    """The cheapest edits of one conversation, row by row, given out as soon as they are certain."""

    def __init__(self):
        self.tree = Tree()
        self.step = 0
        first = Survivor(0, self.tree.root, (0, "", 0))
        self._take([first, None, None, None], [(START, ""), None, None, None], [first, None, None, None])

    def _take(self, old: list, way: list, base: list) -> None:
        """Survivors after a row's edit, `base`, and the inserts after it."""
        cost = [s.cost if s else None for s in base]
        for state, sources in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            for source in sources:
                if way[source] is None:
                    continue
                c, w = cost[source] + INSERT, (way[source][0], way[source][1] + "I")
                if way[state] is None or c < cost[state] or c == cost[state] and _before(w, way[state], old):
                    cost[state], way[state] = c, w
        # Whatever follows START or SYSTEM can follow ASSISTANT too, with one more row deleted at most.
        for state, more in ((START, DELETE), (SYSTEM, 0)):
            if way[state] is not None and way[ASSISTANT] is not None and cost[ASSISTANT] + more < cost[state]:
                way[state] = None
        new: list[Survivor | None] = [None] * 4
        nodes: dict[tuple[int, str], int] = {}
        for state in range(4):
            if way[state] is None:
                continue
            source, text = way[state]
            node, own = old[source].node, ""
            for e in text:
                own += e
                if (source, own) not in nodes:
                    nodes[source, own] = self.tree.node(node, e)
                node = nodes[source, own]
            inserts = len(text) - len(text.rstrip("I"))
            new[state] = Survivor(cost[state], node, (self.step, source, text.rstrip("I")), inserts)
        self.step += 1
        order = sorted((s for s in range(4) if new[s]), key=cmp_to_key(
            lambda x, y: 0 if way[x] == way[y] else -1 if _before(way[x], way[y], old) else 1))
        for place, state in enumerate(order):
            new[state].place = place
            self.tree.hold(new[state].node)
        if self.step > 1:
            for s in old:
                if s:
                    self.tree.drop(s.node)
        self.now = new

    def row(self, initial: str, fault: str | None):
        """Take a row; gives the edits that are certain now."""
        old, way, base = self.now, [None] * 4, [None] * 4
        extra = TRUNCATED if fault == "truncated" else 0
        for source, s in enumerate(old):
            if s is None:
                continue
            moves = [(source, "D", DELETE)]
            if fault not in ("blank", "duplicate"):
                moves.append((GIVEN[source], "R", CHANGE + extra))
                if (source, initial) in KEPT:
                    moves.append((KEPT[source, initial], "K", extra))
            for state, edit, c in moves:
                c, w = c + s.cost, (source, edit)
                if way[state] is None or c < base[state].cost or c == base[state].cost and _before(w, way[state], old):
                    way[state], base[state] = w, Survivor(c, -1, ())
        self._take(old, way, base)
        yield from self.tree.settled([s.node for s in self.now if s])

    def end(self):
        """The rest of the edits; the repaired rows are none, or end with an assistant."""
        ends = [self.now[s] for s in (START, ASSISTANT) if self.now[s]]
        best = min(ends, key=lambda s: (s.cost, s.place))
        for s in self.now:
            if s and s is not best:
                self.tree.drop(s.node)
        yield from self.tree.settled([best.node])


def _fault(text: Column, nth: Column) -> Column:
    last = F.right(F.rtrim(text, F.lit(BLANK_CHARS)), F.lit(1))
    return F.when(last == "", "blank").when(nth > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")


def with_faults(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, fault) in order, conversation after conversation: by turn (nulls
    first), then role and text. fault is a row's first of: blank (white space only), duplicate (role
    and text seen earlier in the conversation), truncated (last visible character none of .!?).
    Null roles and texts are one space; rows of a null conversation are one conversation.

    One shuffle, by conversation; repeated texts are numbered in a sorted window and the order
    is that of a sort that spills, so a task holds no conversation.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    own = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"))
    alike = Window.partitionBy("conv", "role", F.md5(F.col("text").cast("binary"))).orderBy(F.asc_nulls_first("turn"))
    own = own.repartition("conv").withColumn("nth", F.row_number().over(alike))
    own = own.withColumn("fault", _fault(F.col("text"), F.col("nth")))
    return own.sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text", "nth").drop("nth")


def repairs(rows: DataFrame) -> DataFrame:
    """(conv, seq, edit, cost, turn, role, text, fault, old_role): the cheapest edits of the rows
    of `with_faults`, in order. edit is K (keep), R (role changed from old_role to role), D
    (deleted; the row as it was) or I (an inserted row without text). The rows but the deleted ones are the
    repaired conversation: an optional system row, then user and assistant in turns, or nothing.

    Costs: R 1, D 2 (required for blank and duplicate rows), I 5, and 5 for a truncated row that
    stays. Of equally cheap edits those that are least as a string win. seq counts from 0. Only
    the first characters of roles (s, u, a) count; other roles, an empty one too, can not stay.

    A task streams conversations. It holds the edits on which the survivors of the four states
    differ still; what they share is given out. Open rows beyond 64 MB go to a local file.
    """

    def run(batches):
        search, conv, seq, state, out, size, wait = None, None, 0, START, [], 0, Rows()

        def give(edits):
            nonlocal seq, state, size
            for e in edits:
                turn, role, text, fault = (None, None, "", None) if e == "I" else wait.get()
                old_role = role
                cost = {"K": 0, "R": CHANGE, "D": DELETE, "I": INSERT}[e] + (TRUNCATED if fault == "truncated" and e != "D" else 0)
                if e == "K":
                    state = KEPT[state, role[:1]]
                elif e != "D":
                    state = GIVEN[state]
                    role = NAMES[state]
                out.append((conv, seq, e, cost, turn, role, text, fault, old_role))
                seq, size = seq + 1, size + len(text)

        def full(least):
            nonlocal out, size
            if out and size + 64 * len(out) >= least:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out, size = [], 0

        try:
            for batch in batches:
                for c, turn, role, text, fault in zip(*(x.to_pylist() for x in batch.columns)):
                    if search is None or c != conv:
                        if search is not None:
                            give(search.end())
                        search, conv, seq, state = Search(), c, 0, START
                    wait.put((turn, role, text, fault))
                    give(search.row(role[:1], fault))
                    yield from full(FLUSH)
            if search is not None:
                give(search.end())
            yield from full(0)
        finally:
            wait.close()

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("conv", "turn")}
    said = f"conv {kinds['conv']}, seq long, edit string, cost long, turn {kinds['turn']}, role string, text string, fault string, old_role string"
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], said).schema)
    return rows.mapInArrow(run, said)


def repair_report(edits: DataFrame) -> DataFrame:
    """One row for each conversation of `repairs`: (conv, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256). gaps are turns missing between the least and the
    greatest (nulls ignored), the next three count rows by fault, illegal counts neighbouring rows
    that are not system and user, user and assistant or assistant and user, all before repair;
    audit is the string of edits, and the digest is of the repaired `role:text`, by newlines."""

    def run(batches):
        state = None

        def row():
            conv, (low, high, n), faults, illegal, _, cost, audit, sha, _ = state
            return (conv, high - low + 1 - n if n else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost,
                    "".join(audit), sha.hexdigest())

        def table_of(out):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(schema), schema)], schema=schema)

        for batch in batches:
            out = []
            for conv, seq, edit, cost, turn, role, text, fault, was in zip(*(x.to_pylist() for x in batch.columns)):
                if seq == 0:
                    if state:
                        out.append(row())
                    state = [conv, (0, 0, 0), dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0, None, 0, [], hashlib.sha256(), False]
                if edit != "I":
                    low, high, n = state[1]
                    if turn is not None and (not n or turn != high):
                        state[1] = (low if n else turn, turn, n + 1)
                    if fault:
                        state[2][fault] += 1
                    if state[4] is not None and state[4] + was[:1] not in ("su", "ua", "au"):
                        state[3] += 1
                    state[4] = was[:1]
                if edit != "D":
                    state[7].update(("\n" * state[8] + f"{role}:{text}").encode())
                    state[8] = True
                state[5] += cost
                state[6].append(edit)
            yield table_of(out)
        if state:
            yield table_of([row()])

    said = (f"conv {edits.schema['conv'].dataType.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, "
            "cost long, audit string, repaired_sha256 string")
    schema = to_arrow_schema(edits.sparkSession.createDataFrame([], said).schema)
    return edits.mapInArrow(run, said)


def damaged(rows: DataFrame) -> DataFrame:
    """The conversations of the contract: rows dropped, emptied, cut, repeated or given to the
    user by the checksum of conv_id and turn. Nulls are one space, in the checksum too."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"),
                      (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times))).drop("col")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = repair_report(repairs(with_faults(damaged(rows))))
    every = rows.select("conv_id").distinct()
    counts = [c for c in found.columns if c not in ("conv", "audit", "repaired_sha256")]
    return every.join(found, every.conv_id.eqNullSafe(found.conv), "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


_WAYS = [(s, "D", None, s, DELETE) for s in range(4)] + [(s, "R", None, t, CHANGE) for s, t in enumerate(GIVEN)] + [
    (s, "K", i, t, 0) for (s, i), t in KEPT.items()]
_SQL = lambda v: "NULL" if v is None else repr(v)

OP12_SQL = f"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
    FROM conversations
), kinds AS (
    SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(name)), lambda i: ascii(name[i + 1])::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
            lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS kind
    FROM keyed
), damaged AS (
    SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM kinds
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
           right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last
    FROM damaged
), faults AS (
    SELECT conv_id, turn, role, text, n, CASE WHEN last = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
           WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
           left(lag(role) OVER (PARTITION BY conv_id ORDER BY n), 1) || left(role, 1) AS pair
    FROM placed
), ways (state, edit, initial, after, cost) AS (
    VALUES {', '.join('(' + ', '.join(map(_SQL, w)) + ')' for w in _WAYS)}
), inserts (after, state, inserted, cost, lines) AS (
    VALUES (0, 0, '', 0, []::VARCHAR[]), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []), (0, 2, 'I', 5, ['user:']), (1, 2, 'I', 5, ['user:']),
           (3, 2, 'I', 5, ['user:']), (2, 3, 'I', 5, ['assistant:']), (0, 3, 'II', 10, ['user:', 'assistant:']), (1, 3, 'II', 10, ['user:', 'assistant:'])
), best AS (
    SELECT conv_id, 0::BIGINT AS n, i.state, i.cost::BIGINT AS cost, i.inserted AS audit, i.lines
    FROM (SELECT DISTINCT conv_id FROM faults) AS c, inserts AS i WHERE i.after = 0
    UNION ALL
    SELECT b.conv_id, f.n, i.state, b.cost + w.cost + i.cost + CASE WHEN f.fault = 'truncated' AND w.edit <> 'D' THEN 5 ELSE 0 END AS cost,
           b.audit || w.edit || i.inserted AS audit,
           b.lines || CASE w.edit WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text]
                      ELSE [CASE w.after WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || f.text] END || i.lines AS lines
    FROM best AS b JOIN faults AS f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.n = b.n + 1
    JOIN ways AS w ON w.state = b.state AND (w.initial IS NULL OR w.initial = left(f.role, 1))
                   AND (w.edit = 'D' OR coalesce(f.fault, '') NOT IN ('blank', 'duplicate'))
    JOIN inserts AS i ON i.after = w.after
    QUALIFY row_number() OVER (PARTITION BY b.conv_id, i.state ORDER BY b.cost + w.cost + i.cost + CASE WHEN f.fault = 'truncated' AND w.edit <> 'D' THEN 5 ELSE 0 END,
                               b.audit || w.edit || i.inserted) = 1
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
           count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
           count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n
    FROM faults GROUP BY conv_id
), ended AS (
    SELECT c.*, b.cost, b.audit, b.lines, row_number() OVER (PARTITION BY c.conv_id ORDER BY b.cost, b.audit) AS place
    FROM counted AS c JOIN best AS b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.n = c.n AND b.state IN (0, 3)
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o
LEFT JOIN ended AS e ON e.conv_id IS NOT DISTINCT FROM o.conv_id AND e.place = 1
"""
