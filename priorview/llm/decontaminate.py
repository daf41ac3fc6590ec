"""Benchmark passages in documents, by edit distance over words.

Words are the symbols. CGK's random walk reads a sequence and repeats each symbol a random
number of times, decided by the symbol and the step; sequences within a small edit distance
fall into step again after each edit, so their walks agree at most steps (Hamming distance).
A bucket key is the walk at a few sampled steps, and the walk is repeated with new random
bits until items are found with the wanted probability.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import repeat
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WORD = re.compile(r"\w+")
PAD, OTHER = 0, 1       # symbols: no word, a word of no item
RATE = 0.2              # most edits, as a share of an item's words
LEAST = 5               # words of the shortest item that is looked for
STEPS = 4               # sampled steps of a bucket key
RECALL = 0.98           # at the largest distance
TRIED = 1000            # edited copies on which recall is measured
GROWTH = 1.25           # of the window from one class of items to the next
BLOCK = 20_000          # items sent to a task at once
RUN = 500_000           # words looked at together
GROUP = 1 << 14         # windows walked together


PAIR_BITS = 22


def _pair_slots(symbols: np.ndarray) -> np.ndarray:
    mixed = symbols[:-1] * np.uint64(0x9E3779B97F4A7C15) + symbols[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def folded(text: str | None) -> str:
    """The text in lower case, character by character, so that places stay the same."""
    low = (text or "").lower()
    return low if len(low) == len(text or "") else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def words(text: str | None) -> list[str]:
    return WORD.findall(folded(text))


def _walk(symbols: np.ndarray, starts: np.ndarray, window: int, mult: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Bucket keys of the windows at `starts`: the symbols under the walk at the given steps."""
    return _walk_after(symbols + np.uint64(1), starts, window, mult, steps)


def _walk_after(after: np.ndarray, starts: np.ndarray, window: int, mult: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """`_walk` from the symbols plus one. Windows go in groups that stay in a core's cache."""
    return np.concatenate([_keys(after, starts[k:k + GROUP], window, mult, steps) for k in range(0, len(starts), GROUP)]
                          or [np.empty(0, np.uint64)])


def _keys(after: np.ndarray, starts: np.ndarray, window: int, mult: np.ndarray, steps: np.ndarray) -> np.ndarray:
    at, end = starts.astype(np.int64), starts + window
    key = np.full(len(starts), np.uint64(0x9E3779B97F4A7C15), np.uint64)
    wanted = set(steps.tolist())
    for step in range(int(steps[-1]) + 1):
        # A walk is at most one word further with each step, so only the later steps can leave the window.
        here = after[at] if step < window else np.where(at < end, after[np.minimum(at, len(after) - 1)], np.uint64(PAD + 1))
        if step in wanted:
            key = (key ^ here - np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
        here *= mult[step]
        here >>= np.uint64(63)
        at += here.view(np.int64)
    return key


def distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(fewest edits, end) of the item against any stretch of the text."""
    ramp = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for k, x in enumerate(item):
        best = row + 1
        best[1:] = np.minimum(best[1:], row[:-1] + (text != x))
        best[0] = k + 1
        row = np.minimum.accumulate(best - ramp) + ramp
    end = int(np.argmin(row))
    return int(row[end]), end


def _edited(item: np.ndarray, edits: int, rng) -> np.ndarray:
    """The item after random edits, padded at its end to be no shorter."""
    x = item.tolist()
    for _ in range(edits):
        at, kind = int(rng.integers(len(x))), rng.integers(3)
        x[at:at + (kind > 0)] = [OTHER] if kind < 2 else []
    return np.array(x + [PAD] * edits, np.uint64)


@dataclass
class _Class:
    """Items of like length and their bucket keys, one set of keys for each repeated walk."""

    window: int
    spare: int                 # most words of a window that are in no item
    walks: list[tuple[np.ndarray, np.ndarray]]
    keys: list[np.ndarray]     # sorted, with the item of each
    items: list[np.ndarray]


class Index:
    """A block of items, ready for a task."""

    def __init__(self, rows: list[tuple], rate: float = RATE, recall: float = RECALL, steps: int = STEPS, seed: int = 11):
        rng = np.random.default_rng(seed)
        split = [(i, w) for i, t in rows if len(w := words(t)) >= LEAST]
        self.ids = [i for i, _ in split]
        vocabulary = sorted({x for _, w in split for x in w})
        self.symbol = {w: k + 2 for k, w in enumerate(vocabulary)}
        self.items = [np.array([self.symbol[x] for x in w], np.uint64) for _, w in split]
        # Marks of the items' neighbouring words, by hash: chance can only add marks.
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        for x in self.items:
            self.pairs[_pair_slots(x)] = True
        self.most = [floor(rate * len(x)) for x in self.items]
        self.classes: list[_Class] = []
        order = sorted(range(len(self.items)), key=lambda k: len(self.items[k]))
        while order:
            window = len(self.items[order[0]])
            own = [k for k in order if len(self.items[k]) <= window * GROWTH]
            order = order[len(own):]
            self.classes.append(self._class(own, window, rate, recall, steps, rng))

    def _class(self, own: list[int], window: int, rate: float, recall: float, steps: int, rng) -> _Class:
        heads = np.concatenate([self.items[k][:window] for k in own])
        starts = np.arange(len(own)) * window
        out = _Class(window, max(self.most[k] for k in own), [], [], [])
        # Keys are added until the largest number of edits of each item is survived with the wanted
        # probability, measured on edited copies of the items, and until fresh copies agree.
        def copies():
            tried = [(self.items[k], self.most[k]) for k in rng.choice(own, TRIED)]
            return (np.concatenate([x[:window] for x, _ in tried]), np.concatenate([_edited(x, n, rng)[:window] for x, n in tried]))

        def meet(walk, originals, edited):
            return _walk(edited, at, window, *walk) == _walk(originals, at, window, *walk)

        at = np.arange(TRIED) * window
        tried, found = copies(), np.zeros(TRIED, bool)
        while True:
            if found.mean() >= recall:
                tried = copies()
                found = np.logical_or.reduce([meet(walk, *tried) for walk in out.walks])
                if found.mean() >= recall:
                    break
            mult = rng.integers(1, 1 << 63, 2 * window, np.uint64) * np.uint64(2) + np.uint64(1)
            where = np.sort(rng.choice(2 * window, min(steps, 2 * window), replace=False))
            keys = _walk(heads, starts, window, mult, where)
            order = np.argsort(keys, kind="stable")
            out.walks.append((mult, where))
            out.keys.append(keys[order])
            out.items.append(np.array(own)[order])
            found |= meet(out.walks[-1], *tried)
        return out

    def scan(self, texts: list[str | None]):
        """(row, item, first word, end word, edits) of the best place of each item in each text."""
        for part in _runs(texts):
            yield from self._scan(part)

    def _scan(self, rows: list[tuple[int, list[str]]]):
        gap = max((c.window for c in self.classes), default=0)
        lengths = np.array([len(w) for _, w in rows])
        first = np.cumsum(lengths + gap) - lengths - gap
        symbols = np.zeros(int((lengths + gap).sum()) + 1, np.uint64)
        for (_, w), a in zip(rows, first, strict=True):
            symbols[a:a + len(w)] = np.fromiter(map(self.symbol.get, w, repeat(OTHER)), np.uint64, len(w))
        after = symbols + np.uint64(1)
        known = np.concatenate([[0], np.cumsum(symbols > OTHER)])
        follow = np.concatenate([[0], np.cumsum(self.pairs[_pair_slots(symbols)])])
        pairs = []
        for c in self.classes:
            if len(symbols) <= c.window:
                continue
            # Each edit brings at most one word of no item and breaks at most two pairs of neighbours,
            # so a window with more of either is near no item and is not walked.
            w = c.window
            starts = np.nonzero((known[w:] - known[:-w] >= w - c.spare)
                                & (follow[w - 1:] - follow[:len(follow) - w + 1] >= w - 1 - 2 * c.spare))[0]
            for at in range(0, len(starts), 1 << 18):
                some = starts[at:at + (1 << 18)]
                for (mult, where), keys, items in zip(c.walks, c.keys, c.items, strict=True):
                    key = _walk_after(after, some, c.window, mult, where)
                    lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                    hit = np.nonzero(hi > lo)[0]
                    n = (hi - lo)[hit]
                    shift = np.repeat(lo[hit] - np.cumsum(n) + n, n)
                    pairs.append(np.stack([np.repeat(some[hit], n), items[shift + np.arange(n.sum())]]))
        if not pairs:
            return
        pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
        row = np.searchsorted(first, pairs[0], "right") - 1
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        held = np.zeros(len(self.symbol) + 2, bool)  # marks of the symbols of a stretch
        for k, start, item in zip(row.tolist(), pairs[0].tolist(), pairs[1].tolist(), strict=True):
            most, x = self.most[item], self.items[item]
            had = best.get((k, item))
            if had and (had[0] == 0 or had[1] <= start - first[k] < had[2]):
                continue
            lo = max(int(first[k]), start - most)
            text = symbols[lo:min(int(first[k] + lengths[k]), start + len(x) + 2 * most)]
            held[text] = True
            enough = held[x].sum() >= len(x) - most
            held[text] = False
            if not enough:
                continue
            edits, end = distance(x, text)
            if edits <= most and (not had or edits < had[0]):
                begin = end - distance(x[::-1], text[:end][::-1])[1]
                a = lo - int(first[k])
                best[k, item] = (edits, a + begin, a + end)
        for (k, item), (edits, a, b) in best.items():
            yield rows[k][0], item, a, b, edits


def _runs(texts: list[str | None]):
    """Rows as words, in groups of a bounded number of words (a longer row is a group)."""
    part, n = [], 0
    for k, text in enumerate(texts):
        w = words(text)
        if part and n + len(w) > RUN:
            yield part
            part, n = [], 0
        part.append((k, w))
        n += len(w)
    if part:
        yield part


def _blocks(items: DataFrame, id_col: str, text_col: str, block: int, **how):
    """The items as broadcast indexes of up to about `block` items each."""
    spark = items.sparkSession
    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).where("text is not null")
    number = max(1, ceil(rows.count() / block))
    for k in range(number):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(number)) == k).collect()
        yield spark.sparkContext.broadcast(Index(sorted((tuple(r) for r in part), key=str), **how))


def passages(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
             item_text: str = "text", block: int = BLOCK, **how) -> DataFrame:
    """(id, item, start, end, edits, words): each document row and each item that it holds.

    An item is held where some stretch of the document is within `rate` (a fifth) of the item's
    words in word edits; words are runs of letters, digits and underscores in lower case. The
    best place is returned, in code points. Items under five words are never found: by chance
    they are everywhere. Items go to the tasks in blocks, each of which is one scan of the
    documents, so a task's memory is bounded whatever the number of items.

    Candidates come from the bucket keys of item-sized windows at every word. Windows with more
    words outside all items than the allowed edits are not walked; that loses nothing. Each
    class of items has as many walks as its edited copies need for the wanted recall. Exact
    copies are always found. Null and empty texts hold nothing, repeated rows stay, null ids
    stay null, empty tables give no rows, other columns are not read.
    """
    def job(held):
        def run(batches):
            index = held.value
            for batch in batches:
                texts = batch.column(1).to_pylist()
                rows = []
                for k, item, a, b, edits in index.scan(texts):
                    places = [m.span() for m, _ in zip(WORD.finditer(folded(texts[k])), range(b), strict=False)]
                    rows.append((k, index.ids[item], places[a][0], places[b - 1][1], edits, len(index.items[item])))
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()),
                     *(pa.array(c, pa.int32()) for c in cols[2:])], ["id", "item", "start", "end", "edits", "words"])
        return run

    kind = docs.schema[id_col].dataType.simpleString()
    rows, out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), None
    for held in _blocks(items, item_id, item_text, block, **how):
        found = rows.mapInArrow(job(held), f"id {kind}, item long, start int, end int, edits int, words int")
        out = found if out is None else out.unionAll(found)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                   item_text: str = "text", block: int = BLOCK, **how) -> DataFrame:
    """The documents that hold no item, with all their columns; see `passages`."""
    for held in _blocks(items, item_id, item_text, block, **how):
        place = docs.columns.index(text_col)

        def run(batches, held=held):
            for batch in batches:
                bad = {k for k, *_ in held.value.scan(batch.column(place).to_pylist())}
                yield batch.take(pa.array([k for k in range(batch.num_rows) if k not in bad], pa.int64()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and item that it holds."""
    found = passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})
