"""Best-fit packing of token sequences, planned over the histogram of lengths."""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

SEPARATOR = 1        # fixed value: the id after each document
NOT_SPACE = "\x1c\x1d\x1e\x1f"  # white space to Python, not to the tokenizer
CACHE = 1_000_000    # words that a Python worker remembers


class WordTokenizer:
    """Ids of whole texts for a lower-casing byte-level BPE that drops white space and never
    joins across it.

    Each distinct word is encoded once while it stays in the cache; `ids` joins the words' ids
    with array look-ups. The result equals encoding the text as one piece.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok, self.cache = Tokenizer.from_file(path), cache
        self.tok.encode_special_tokens = True
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        # The byte alphabet, for the two-byte letters of Latin scripts.
        self.letters = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x250) if chr(c).isalpha()}
        self.marks = {c: self._whole(c) for c in ",."}
        self.clear()

    def _whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.size, self.start, self.flat = array("q"), array("q"), array("i")

    def _learn(self, words: list[str]) -> None:
        known, rest, tokenize = dict(self.marks), [], self.tok.model.tokenize
        bare = []
        for w in words:
            # "word," and "word." are the ids of the word and of the mark.
            b = w[:-1] if w[-1] in ",." else w
            if b.isalpha() and max(b) < "\u0250" and "\u0130" not in b:  # one pre-token, no normalisation but case
                if b not in known:
                    known[b] = [t.id for t in tokenize(b.lower() if b.isascii() else b.lower().translate(self.letters))]
            else:
                b = w
                rest.append(w)
            bare.append(b)
        known |= {w: self._whole(w) for w in rest}
        for w, b in zip(words, bare):
            ids = known[b] if len(b) == len(w) else known[b] + known[w[-1]]
            self.index[w] = len(self.size)
            self.size.append(len(ids))
            self.start.append(len(self.flat))
            self.flat.extend(ids)

    def ids(self, text: str) -> np.ndarray:
        if any(c in text for c in NOT_SPACE):
            return np.array(self._whole(text), np.int32)
        if text.isascii():
            text = text.lower()  # as the tokenizer does; fewer distinct words
        words = text.split()
        try:
            where = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        except KeyError:
            fresh = list({w for w in words if w not in self.index})
            if len(self.index) + len(fresh) > self.cache and self.index:
                self.clear()
                fresh = list(set(words))
            self._learn(fresh)
            where = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if not words:
            return np.empty(0, np.int32)
        size = np.frombuffer(self.size, np.int64)[where]
        end = np.cumsum(size)
        shift = np.frombuffer(self.start, np.int64)[where] - end + size
        return np.frombuffer(self.flat, np.int32)[np.repeat(shift, size) + np.arange(end[-1])]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           limit: int = 4096) -> DataFrame:
    """(id, piece, start, length, crc): each text's ids and a separator, cut at `limit` ids."""

    def run(batches):
        tok = _tokenizer(tokenizer)
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = np.append(tok.ids(text.as_py() or ""), SEPARATOR).astype("<u4")
                for k, a in enumerate(range(0, len(ids), limit)):
                    part = ids[a:a + limit]
                    at.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "crc"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, piece int, start long, length long, crc long")


def plan(histogram: dict[int, int], limit: int) -> pd.DataFrame:
    """Best-fit decreasing over counts: slots (length, low, high, per, base, offset).

    Items of a length with ranks low..high-1 fill, `per` to a sequence, the sequences from
    `base` on at the given offset. Lengths go from long to short; each goes to the sequences
    with the least room that holds it, as many as fit into each. A step splits one class of
    alike sequences and opens one, so there are about as many slots as pairs of length and
    class, whatever the number of items.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> (base, sequences)
    slots, bases = [], 0
    for length in sorted(histogram, reverse=True):
        left, low = histogram[length], 0

        def fill(space: int, base: int, number: int) -> None:
            """Put items into up to `number` alike sequences, as many as fit into each."""
            nonlocal left, low
            per = space // length
            full = min(number, left // per)
            if full:
                slots.append((length, low, low + full * per, per, base, limit - space))
                room[space - per * length].append((base, full))
                low, left = low + full * per, left - full * per
            if left and full < number:
                slots.append((length, low, low + left, left, base + full, limit - space))
                room[space - left * length].append((base + full, 1))
                low, left, full = low + left, 0, full + 1
            if full < number:
                room[space].append((base + full, number - full))

        for space in sorted(s for s in room if s >= length):
            for base, number in room.pop(space):
                if left:
                    fill(space, base, number)
                else:
                    room[space].append((base, number))
            if not left:
                break
        if left:
            number = -(-left // (limit // length))
            bases, base = bases + number, bases
            fill(limit, base, number)
    return pd.DataFrame(slots, columns=["length", "low", "high", "per", "base", "offset"], dtype="int64")


def _ranked(items: DataFrame) -> DataFrame:
    """Items with their rank within their length, from 0. Ranks are counted inside slices of a
    length and raised by the slices before, so a frequent length is not one task's work."""
    n = max(64, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [c for c in items.columns]
    cut = items.withColumn("slice", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))
    counts = cut.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = counts.select("length", "slice", F.expr(
        "sum(n) OVER (PARTITION BY length ORDER BY slice) - n").alias("before"))
    inner = "row_number() OVER (PARTITION BY length, slice ORDER BY " + ", ".join(keys) + ") - 1"
    ranked = cut.withColumn("inner", F.expr(inner))
    return ranked.join(before, ["length", "slice"]).withColumn("rank", F.expr("before + inner")).drop("slice", "inner", "before")


def pack(items: DataFrame, limit: int = 4096) -> DataFrame:
    """Items with a positive `length` of at most `limit` -> the same with sequence_id and offset. The
    names slice, inner, before and rank must be free.

    Sequences are gapless from offset 0 and hold at most `limit`. The histogram has at most
    `limit` rows; it alone goes to the driver, which plans on it. The plan's slots go back to
    the tasks as arrays, and each item finds its slot by its rank within its length. Rows that
    are equal in every column are interchangeable. No items give no rows.
    """
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = plan(histogram, limit)
    names, lengths = slots.columns, slots.groupby("length").indices
    arrays = {k: slots[k].to_numpy() for k in names}
    first = {length: (at[0], at[-1] + 1) for length, at in lengths.items()}

    def place(batches):
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            slot = np.empty(len(b), np.int64)
            for x in np.unique(length):
                lo, hi = first[x]
                mine = length == x
                slot[mine] = lo + np.searchsorted(arrays["low"][lo:hi], rank[mine], "right") - 1
            inside = rank - arrays["low"][slot]
            per = arrays["per"][slot]
            b["sequence_id"] = arrays["base"][slot] + inside // per
            b["offset"] = arrays["offset"][slot] + inside % per * length
            yield b.drop(columns="rank")

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return _ranked(items).select(*items.columns, "rank").mapInPandas(place, f"{kind}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                     limit: int = 4096) -> DataFrame:
    """(id, piece, start, length, crc, sequence_id, offset): every text in a sequence.

    Null and empty texts are the separator alone. Long texts are cut into pieces of `limit`;
    nothing is dropped. Rows of equal id and text get places of their own; null ids stay null.
    Only the two named columns are read. An empty table gives no rows.
    """
    return pack(stored(pieces(docs, tokenizer, id_col, text_col, limit), "pieces"), limit)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    out = packed_documents(table(spark, sf_dir, "documents"), path("word_bpe_49k.json"))
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"),
                      "sequence_id", "offset")
