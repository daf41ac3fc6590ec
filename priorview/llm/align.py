"""Alignment of two tokenizers over the same bytes, merged in lockstep."""

from __future__ import annotations

import hashlib
import json
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

CHUNK = 1 << 20   # characters of text that advance together
NAMES = ["a_ids", "b_ids", "a_cuts", "b_cuts"]
LANE = 2048       # bytes after which a long text goes on in a lane of its own


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 letters stand
    for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """The bytes of each id, and their lengths."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.size = np.array([len(t) for t in self.tokens], np.int64)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


class ByteLevel(Vocabulary):
    """A byte-level BPE read from its vocabulary file. The ids of its merges are in the order of
    the merges, so the file is run as a table of ranks, which is faster and gives the same ids."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        letters = _byte_letters()
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        added = {t["content"] for t in told.get("added_tokens", [])}
        tokens = {i: bytes(letters[c] for c in t) for t, i in told["model"]["vocab"].items() if t not in added}
        super().__init__(tokens)
        self.own = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={t: i for i, t in tokens.items()}, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.own.encode_ordinary(" " + t), np.int64) for t in texts]


class Pieces(Vocabulary):
    """A vocabulary of pieces with bytes as fall-back; it puts a space before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        names = {i: self.own.id_to_piece(i) for i in range(self.own.vocab_size())}
        super().__init__({i: bytes([int(t[3:5], 16)]) if self.own.is_byte(i) else t.replace("▁", " ").encode()
                          for i, t in names.items()})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.own.encode(texts, num_threads=1)]


class Pair:
    """Two vocabularies, and all pairs of ids that can end together.

    Where an A and a B token end at the same byte, one's bytes end with the other's. So the
    pairs are known from the vocabularies, at most one for each end of each token, whatever the
    number of texts; `keys` has them in order.
    """

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.width = len(self.b.tokens)
        where: list[dict[bytes, list[int]]] = []
        for v in (self.a, self.b):
            own = defaultdict(list)
            for i, t in enumerate(v.tokens):
                if t:
                    own[t].append(i)
            where.append(own)
        found = array("q")
        for v, (mine, other) in ((self.a, (self.width, 1)), (self.b, (1, self.width))):
            ends = where[1] if v is self.a else where[0]
            for i, t in enumerate(v.tokens):
                for k in range(len(t)):
                    found.extend(i * mine + j * other for j in ends.get(t[k:], ()))
        self.keys = np.unique(np.frombuffer(found, np.int64))

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, a * self.width + b).astype(np.int32)


_PAIRS: dict[tuple[str, str], Pair] = {}


def _pair(a: str, b: str) -> Pair:
    if (a, b) not in _PAIRS:
        _PAIRS[a, b] = Pair(a, b)
    return _PAIRS[a, b]


def lockstep(a: np.ndarray, b: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a and in b, both ascending byte offsets without repeats, of offsets in both.

    The bytes between two neighbouring `edges` are a lane; a lane has a pointer into a and one
    into b. Each step compares what all lanes point at, emits the equal ones, moves the smaller
    pointer of each lane (both where equal) and drops the lanes that are at an end.
    """
    i, i_end = (np.searchsorted(a, e, "right") for e in (edges[:-1], edges[1:]))
    j, j_end = (np.searchsorted(b, e, "right") for e in (edges[:-1], edges[1:]))
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while True:
        live = (i < i_end) & (j < j_end)
        if not live.all():
            i, i_end, j, j_end = i[live], i_end[live], j[live], j_end[live]
        if not len(i):
            break
        x, y = a[i], b[j]
        same = x == y
        left.append(i[same])
        right.append(j[same])
        i, j = i + (x <= y), j + (y <= x)
    return np.sort(np.concatenate(left)), np.sort(np.concatenate(right))


def _chunks(texts: pa.Array):
    """Ranges of rows of about CHUNK characters."""
    held = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)) // CHUNK
    cuts = [0, *(np.nonzero(np.diff(held))[0] + 1).tolist(), len(texts)]
    yield from ((x, y) for x, y in zip(cuts, cuts[1:]) if x < y)


def _aligned(pair: Pair, texts: list[str | None]) -> list[tuple[np.ndarray, ...]]:
    """(a ids, b ids, a cuts, b cuts) of each text; see `align`."""
    none = (np.empty(0, np.int64),) * 4
    rows = [k for k, t in enumerate(texts) if t]
    some = [texts[k] for k in rows]
    found = []
    for k, t, a, b in zip(rows, some, pair.a.encode(some), pair.b.encode(some)):
        raw = b" " + t.encode()
        if pair.a.joined(a) == raw == pair.b.joined(b):
            found.append((k, len(raw), a, b))
    out = [none] * len(texts)
    if not found:
        return out
    bases = np.cumsum([0, *(n for _, n, _, _ in found)])
    edges = np.unique(np.concatenate([bases, *(np.arange(x, y, LANE) for x, y in zip(bases[:-1], bases[1:]))]))
    flat = [np.concatenate(ids) for ids in ([f[2] for f in found], [f[3] for f in found])]
    ends = [np.cumsum(v.size[ids]) for v, ids in zip((pair.a, pair.b), flat)]
    cuts = [c + 1 for c in lockstep(*ends, edges)]
    starts = [np.cumsum([0, *(len(f[s]) for f in found)]) for s in (2, 3)]
    at = np.searchsorted(cuts[0], starts[0], "right")  # cuts of the texts before
    for n, (k, _, a, b) in enumerate(found):
        own = slice(at[n], at[n + 1])
        out[k] = a, b, cuts[0][own] - starts[0][n], cuts[1][own] - starts[1][n]
    return out


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a_ids, b_ids, a_cuts, b_cuts), one row for each row: the ids of a space and the text in
    the byte-level vocabulary A and in the piece vocabulary B, and the numbers of A and of B
    tokens up to each byte at which tokens of both end. Group k of a text is what lies between
    cuts k and k + 1, and the tokens at a cut are linked.

    Strings of special tokens are plain text. Null and empty texts, and texts whose bytes one of
    the vocabularies does not give back, have empty lists. Repeated rows and null ids stay. Other
    columns are not read, whatever their names; an empty table gives no rows.

    A batch's texts, long ones cut into lanes of equal bytes, advance together; the memory
    follows the chunk of texts that is encoded at once and not the batch.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        lambda batches: _align(_pair(a_path, b_path), batches), f"id {kind}, " + ", ".join(f"{n} array<int>" for n in NAMES))


def _align(pair: Pair, batches):
    for batch in batches:
        for low, high in _chunks(batch.column(1)):
            lists = []
            for column in zip(*_aligned(pair, batch.column(1).slice(low, high - low).to_pylist())):
                offsets = np.cumsum([0, *map(len, column)])
                lists.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(column).astype(np.int32))))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *lists], ["id", *NAMES])


def _flat(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Values and offsets of the lists of an aligned batch."""
    lists = [batch.column(k) for k in range(1, 5)]
    return ([x.flatten().to_numpy().astype(np.int64) for x in lists],
            [np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy())]) for x in lists])


def _link(pair: Pair, batches):
    ends = [b",", b"|", b";"]
    text = [b"%d%b" % (i, e) for i in range(max(len(pair.a.tokens), len(pair.b.tokens))) for e in ends]
    for batch in batches:
        (a, b, a_cut, b_cut), (a_at, b_at, cut_at, _) = _flat(batch)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(cut_at))
        a_cut, b_cut = a_cut + a_at[owner], b_cut + b_at[owner]  # places in the whole batch
        before_a, before_b = (np.concatenate([[0], c[:-1]]) if len(c) else c for c in (a_cut, b_cut))
        group_a, group_b = (np.repeat(np.arange(len(c)), c - p) for c, p in ((a_cut, before_a), (b_cut, before_b)))
        said = np.empty(len(a) + len(b), np.int32)
        last_a, last_b = np.zeros(len(a), np.int32), np.zeros(len(b), np.int32)
        last_a[a_cut - 1], last_b[b_cut - 1] = 1, 2
        said[np.arange(len(a)) + before_b[group_a]] = 3 * a + last_a
        said[np.arange(len(b)) + a_cut[group_b]] = 3 * b + last_b
        at = (a_at + b_at).tolist()
        shas = [hashlib.sha256(b"".join(map(text.__getitem__, said[x:y].tolist()))[:-1]).hexdigest() if x < y else "" for x, y in zip(at, at[1:])]
        links = pa.ListArray.from_arrays(pa.array(cut_at, pa.int32()), pa.array(pair.number(a[a_cut - 1], b[b_cut - 1])))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(np.diff(x), pa.int64()) for x in (a_at, b_at, cut_at)), pa.array(shas, pa.string()), links],
            ["id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])


def with_links(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, groups_sha256, links) from what `align` gives for each row: the
    digest is of `a1,a2|b1;a3|b2,b3` (ids by group), empty without tokens; links are numbers of
    pairs of ids. A task aligns and digests chunk after chunk, so the ids stay with it."""

    def run(batches):
        pair = _pair(a_path, b_path)
        yield from _link(pair, _align(pair, batches))

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, links array<int>")


def link_counts(linked: DataFrame) -> DataFrame:
    """(link, n): how often each pair of ids is linked in all rows, summed in the tasks first."""

    def run(batches):
        held = np.zeros(0, np.int64)
        for batch in batches:
            links = batch.column(0).flatten().to_numpy()
            if len(links):
                own = np.bincount(links, minlength=len(held))
                own[:len(held)] += held
                held = own
        found = np.nonzero(held)[0]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(held[found])], ["link", "n"])

    return linked.select("links").mapInArrow(run, "link int, n long").groupBy("link").agg(F.sum("n").alias("n"))


def scored(linked: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Adds n_links, n_best (links of a count that is the highest of their B id) and count_sum to
    the stored rows of `with_links`. What is collected and sent to the tasks has at most as many
    entries as there are pairs that can end together."""
    spark, pair = linked.sparkSession, _pair(a_path, b_path)
    found = link_counts(linked).toArrow()
    count = np.zeros(len(pair.keys), np.int64)
    count[found.column("link").to_numpy()] = found.column("n").to_numpy()
    most = np.zeros(pair.width, np.int64)
    of_b = pair.keys % pair.width
    np.maximum.at(most, of_b, count)
    sent = spark.sparkContext.broadcast((count, count == most[of_b]))

    def run(batches):
        count, best = sent.value
        for batch in batches:
            lists = batch.column(5)
            links, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            sums = [np.diff(np.concatenate([[0], np.cumsum(v)])[at]) for v in (best[links], count[links])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(np.diff(at), pa.int64()), *(pa.array(s, pa.int64()) for s in sums)],
                                             [*batch.schema.names[:5], "n_links", "n_best", "count_sum"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in linked.schema.fields[:5])
    return linked.mapInArrow(run, f"{kinds}, n_links long, n_best long, count_sum long")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    files = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
    linked = stored(with_links(table(spark, sf_dir, "documents"), *files), "align-links")
    return scored(linked, *files).withColumnRenamed("id", "doc_id")
