"""Chat formatting by assembling tokens: segments are encoded apart, reserved ids mark turns."""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import table

ROLES = ("system", "user", "assistant", "tool")
HEADERS = {role: f"### {role.capitalize()}: " for role in ROLES}
OTHER, OTHER_END, END = "### Role: ", "\n</role>\n", "\n</turn>\n"
MARKS = [*HEADERS.values(), OTHER, OTHER_END, END]
# What must not stand in a text as it is. One backslash more before it says that it is text;
# marks themselves follow a line break or nothing, never a backslash.
CONTROL = "(" + "|".join(re.escape(m.strip()) for m in MARKS) + ")"
ESCAPE, UNESCAPE = re.compile(r"(?<!\\)(\\*+)" + CONTROL), re.compile(r"(?<!\\)\\(\\*+)" + CONTROL)
LEARNED = ("assistant",)


def escape(text: str) -> str:
    return ESCAPE.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2", text)


class Template:
    """Ids of turns and back. Reserved ids follow the vocabulary, one for each mark."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread to a task
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.base = self.tok.get_vocab_size()
        self.mark = {m: self.base + k for k, m in enumerate(MARKS)}

    def encode(self, turns: list[tuple[str, str]], learned: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, loss mask, end of each turn) of (role, text) pairs, one after another."""
        segments = [escape(t) for _, t in turns] + [escape(r) for r, _ in turns if r not in HEADERS]
        coded = [e.ids for e in self.tok.encode_batch(segments, add_special_tokens=False)]
        names = iter(coded[len(turns):])
        flat: list[int] = []
        steps, ends = [], []
        for (role, _), ids in zip(turns, coded):
            flat += [self.mark[HEADERS[role]]] if role in HEADERS else [self.mark[OTHER], *next(names), self.mark[OTHER_END]]
            if role in learned:
                steps += [(len(flat), 1), (len(flat) + len(ids), -1)]
            flat += ids
            flat.append(self.mark[END])
            ends.append(len(flat))
        # The mask is the running sum of the openings and closings of learned segments.
        delta = np.zeros(len(flat) + 1, np.int64)
        at, step = (np.array(x, np.int64) for x in zip(*steps)) if steps else (np.empty(0, np.int64),) * 2
        np.add.at(delta, at, step)
        return np.array(flat, np.int32), np.cumsum(delta[:-1]) > 0, np.array(ends, np.int64)

    def decode(self, parts: list[list[int]]) -> list[str]:
        return self.tok.decode_batch(parts, skip_special_tokens=False)

    def read(self, turns: list[np.ndarray]) -> list[tuple[str, str, int]]:
        """(role, text, characters when written out) of the ids of each turn."""
        back = {i: m for m, i in self.mark.items()}
        pieces, shape = [], []
        for ids in turns:
            marks = np.nonzero(ids >= self.base)[0]
            names = [back[int(i)] for i in ids[marks]]
            inside = [ids[a + 1:b].tolist() for a, b in zip(marks[:-1], marks[1:])]
            shape.append((names, len(inside)))
            pieces += inside
        text, out = iter(self.decode(pieces)), []
        role_of = {h: r for r, h in HEADERS.items()}
        for names, n in shape:
            own = [next(text) for _ in range(n)]
            role = role_of[names[0]] if names[0] in role_of else unescape(own[0])
            out.append((role, unescape(own[-1]), sum(map(len, names)) + sum(map(len, own))))
        return out

    def written(self, ids: np.ndarray) -> str:
        """The formatted text of ids."""
        back, out, at = {i: m for m, i in self.mark.items()}, [], 0
        for k in [*np.nonzero(ids >= self.base)[0].tolist(), len(ids)]:
            out += self.decode([ids[at:k].tolist()]) + ([back[int(ids[k])]] if k < len(ids) else [])
            at = k + 1
        return "".join(out)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    role_of, out = {h: r for r, h in HEADERS.items()}, []
    heads = "|".join(re.escape(h) for h in [*HEADERS.values(), OTHER])
    for m in re.finditer(rf"({heads})((?s:.*?)){re.escape(END)}", text):
        role, body = role_of.get(m[1]), m[2]
        if role is None:
            role, _, body = body.partition(OTHER_END)
            role = unescape(role)
        out.append((role, unescape(body)))
    return out


def format_turns(rows: DataFrame, tokenizer: str, learned: tuple[str, ...] = LEARNED, conv: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """Rows of turns -> (conv, turn, seq, start, ids, loss), one row for each, in order.

    ids are a turn's token ids with its marks, loss says which of them are learned from: the
    text of the `learned` roles and nothing else. seq and start count turns and ids before the
    turn in its conversation. Turns are in order of turn (nulls first), then of their ids.
    Null texts and roles are empty; roles outside the known ones are written out in the header.
    Rows of a null conversation are one conversation. Repeated rows stay. Other columns are not
    read, an empty table gives no rows.

    Encoding comes before the shuffle, spread over all rows. Then a conversation's turns meet
    in one sorted stream of which a task holds a batch at a time, however long it is.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))

    def encode(batches):
        template = Template(tokenizer)
        for batch in batches:
            c, t, r, x = batch.columns
            ids, loss, ends = template.encode(list(zip(r.to_pylist(), x.to_pylist())), learned)
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (ids, loss)]
            yield pa.RecordBatch.from_arrays([c, t, *lists], ["conv", "turn", "ids", "loss"])

    def number(batches):
        last, seq, start = None, 0, 0
        for batch in batches:
            sizes, seqs, starts = batch.column(2).value_lengths().to_pylist(), [], []
            for c, n in zip(batch.column(0).to_pylist(), sizes):
                if last is None or c != last[0]:
                    last, seq, start = (c,), 0, 0
                seqs.append(seq)
                starts.append(start)
                seq, start = seq + 1, start + n
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(seqs, pa.int64()), pa.array(starts, pa.int64()),
                                              *batch.columns[2:]], ["conv", "turn", "seq", "start", "ids", "loss"])

    own = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in ("conv", "turn"))
    coded = own.mapInArrow(encode, f"{kinds}, ids array<int>, loss array<boolean>")
    return coded.repartition("conv").sortWithinPartitions("conv", "turn", "ids").mapInArrow(
        number, f"{kinds}, seq long, start long, ids array<int>, loss array<boolean>")


def digests(turns: DataFrame, tokenizer: str) -> DataFrame:
    """What `format_turns` wrote, read back and digested by conversation, turn after turn."""

    def run(batches):
        template, state = Template(tokenizer), None

        def row():
            conv, n, turns_sha, loss, loss_sha, chars = state
            return conv, n, turns_sha.hexdigest(), loss, loss_sha.hexdigest(), chars

        for batch in batches:
            out = []
            ids = [x.values.to_numpy() for x in batch.column("ids")]
            masks = [x.values.to_numpy(zero_copy_only=False) for x in batch.column("loss")]
            learned = template.decode([i[m].tolist() for i, m in zip(ids, masks)])
            for c, seq, (role, text, chars), part in zip(batch.column("conv").to_pylist(), batch.column("seq").to_pylist(),
                                                         template.read(ids), learned):
                if seq == 0:
                    if state:
                        out.append(row())
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                part = unescape(part)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(part)
                state[4].update(part.encode())
                state[5] += chars
            yield table_of(out)
        if state:
            yield table_of([row()])

    def table_of(out):
        kinds = [conv_kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 6, kinds)], names)

    conv_kind = to_arrow_type(turns.schema["conv"].dataType)
    return turns.mapInArrow(run, f"conv {turns.schema['conv'].dataType.simpleString()}, n_turns long, turns_sha256 string, "
                                 "loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = "\\### Assistant: </turn> ok"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)],
                                  "conv_id long, turn long, role string, text string")
    file = path("byte_bpe_50k.json")
    return digests(format_turns(rows.unionByName(probe), file), file).withColumnRenamed("conv", "conv_id")


OP3_SQL = f"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'
), written AS (
    SELECT *, regexp_replace(text, '({'|'.join(m.strip() for m in MARKS)})', '#\\1', 'g') AS escaped FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(escaped) + CASE {' '.join(f"WHEN role = '{r}' THEN {len(h) + len(END)}" for r, h in HEADERS.items())}
           ELSE length(role) + {len(OTHER) + len(OTHER_END) + len(END)} END)::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""
