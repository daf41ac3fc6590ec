"""Language identification: known words first, shorter and shorter n-grams for the others."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, stored, table

WORD = re.compile(r"[^\W\d_]+")
SAMPLE = 2_000        # labelled rows that a model is fitted on, expected
LONGEST = 5           # letters of the longest n-gram
MIX = 0.01            # share of the mean over the languages in each frequency
EVIDENCE = 25         # words that a score counts at most
CACHE = 250_000       # chunks of text that a Python worker remembers
UNKNOWN = "und"


def words_of(chunk: str) -> list[str]:
    """The runs of letters (Unicode L) of a lower-case text."""
    found = []
    for w in WORD.findall(chunk):
        found += [w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split()
    return found


def _grams(marked: str, size: int) -> list[str]:
    """n-grams of ^word$; the marks count only beside letters."""
    return list(marked[1:-1]) if size == 1 else [marked[j:j + size] for j in range(len(marked) - size + 1)]


@dataclass
class Model:
    """Per-language logarithms of relative frequency, of words and of n-grams: a row of `logs` for
    each, and the dictionaries that find it."""

    languages: list[str]
    logs: np.ndarray | None = None
    words: dict[str, int] = field(default_factory=dict)
    grams: list[dict[str, int]] = field(default_factory=list)  # by length, the longest first

    @classmethod
    def of(cls, rows: list[tuple[str, str, int]], longest: int = LONGEST) -> Model:
        """From (language, word, count). Every word counts once for n-grams: unseen words are
        like the many rare ones, not like the few frequent ones."""
        languages = sorted({r[0] for r in rows})
        at = {x: k for k, x in enumerate(languages)}
        words, grams = {}, [{} for _ in range(longest)]
        counts: dict[int, list] = {}
        keys: list[dict[str, int]] = [words, *grams]

        def add(keyed: dict[str, int], key: str, language: int, n: int) -> None:
            row = keyed.setdefault(key, len(counts))
            counts.setdefault(row, [0] * len(languages))[language] += n

        for language, word, n in rows:
            add(words, word, at[language], n)
            marked = f"^{word}$"
            for k, keyed in enumerate(grams):
                for g in set(_grams(marked, longest - k)):
                    add(keyed, g, at[language], 1)
        table = np.array([counts[k] for k in range(len(counts))], np.float64).reshape(len(counts), len(languages))
        for keyed in keys:
            # Relative frequencies, mixed with a little of their mean over the languages: the
            # sizes of the languages' samples cancel out, and no single word decides alone.
            own = np.fromiter(keyed.values(), np.int64, len(keyed))
            share = table[own] / np.maximum(table[own].sum(0), 1)
            table[own] = np.log((1 - MIX) * share + MIX * share.mean(1, keepdims=True)) if len(own) else 0
        return cls(languages, table.astype(np.float32), words, grams)

    def rows(self, word: str) -> list[int]:
        """A known word's row; else those of its known n-grams of the greatest length at which it
        has any, whose mean is the word's score; else none."""
        known = self.words.get(word)
        if known is not None:
            return [known]
        marked = f"^{word}$"
        for k, grams in enumerate(self.grams):
            found = [grams[g] for g in _grams(marked, len(self.grams) - k) if g in grams]
            if found:
                return found
        return []

    def word(self, word: str) -> np.ndarray:
        found = self.rows(word)
        return self.logs[found].mean(0) if found else np.zeros(len(self.languages))


class Scorer:
    """Predictions for whole texts; white-space separated chunks are scored once while cached."""

    def __init__(self, model: Model, cache: int = CACHE):
        self.model, self.cache = model, cache
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.languages) + 1), np.float32)  # last column: number of words

    def _learn(self, chunks: list[str]) -> None:
        base = len(self.index)
        while base + len(chunks) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[base:base + len(chunks)] = 0
        rows, weights, owners = [], [], []
        for k, chunk in enumerate(chunks):
            words = [chunk] if chunk.isalpha() else words_of(chunk)
            for w in words:
                found = self.model.rows(w)
                rows += found
                weights += [1 / len(found)] * len(found) if found else []
                owners += [k] * len(found)
            self.rows[base + k, -1] = len(words)
            self.index[chunk] = base + k
        if rows:
            part = self.model.logs[rows] * np.array(weights, np.float32)[:, None]
            owners = np.array(owners)
            first = np.nonzero(np.diff(owners, prepend=-1))[0]
            self.rows[base + owners[first], :-1] = np.add.reduceat(part, first, axis=0)

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not self.model.languages:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.model.languages) + 1)
        chunks = (text or "").lower().split()
        for at in range(0, len(chunks), 100_000):
            part = chunks[at:at + 100_000]
            try:
                where = np.fromiter(map(self.index.__getitem__, part), np.int64, len(part))
            except KeyError:
                if len(self.index) > self.cache:
                    self.clear()
                self._learn(list({c for c in part if c not in self.index}))
                where = np.fromiter(map(self.index.__getitem__, part), np.int64, len(part))
            total += self.rows[where].sum(0, dtype=np.float64)
        n = total[-1]
        if not n:
            return UNKNOWN, 0.0
        score = total[:-1] / n * min(n, EVIDENCE)
        best = int(np.argmax(score))
        return self.model.languages[best], float(1 / np.exp(score - score[best]).sum())


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model of the rows' texts and labels. Rows without text or label teach nothing.

    It is fitted on about `sample` rows, chosen by a hash of their id and text, and on all their
    words; so its size has a bound that the table's size does not enter. Repeated texts
    under different ids are different rows. Without labelled rows the model has no languages.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("hash"))
    scale = 1 << 30
    share = min(scale, int(scale * sample / max(1, rows.count())))
    chosen = (rows.where(F.pmod("hash", F.lit(scale)) < share) if share < scale else rows).drop("hash")

    def count(batches):
        for batch in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for chunk in text.as_py().lower().split():
                    seen[lang].update(words_of(chunk))
            flat = [(x, w, n) for x, c in seen.items() for w, n in c.items()]
            cols = list(zip(*flat, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()),
                                              pa.array(cols[2], pa.int64())], ["lang", "word", "n"])

    counts = chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return Model.of([tuple(r) for r in stored(counts, "words").collect()])


def predict(docs: DataFrame, model: Model, columns: list[str], text_col: str = "text") -> DataFrame:
    """The named columns with lang_pred and score.

    lang_pred is one of the model's languages, or `und` with score 0 where the text is null or
    has no letter (or the model has no language). The score is the probability of the
    prediction, from at most 25 words' worth of evidence; text without a known letter gets an
    even score. Only the text is looked at. Rows are independent, repeated rows stay, an empty
    table gives no rows. Where a column is called lang_pred or score, the new one's name ends in _.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    kept = docs.select(*columns)
    names = fresh(kept, "lang_pred", "score")

    def run(batches):
        score = Scorer(held.value)
        for batch in batches:
            found = [score(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([x for x, _ in found], pa.string()),
                                              pa.array([s for _, s in found], pa.float64())],
                                             [*batch.schema.names[1:], *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    text = F.col(text_col).alias("\x00text")
    return docs.select(text, *columns).mapInArrow(run, f"{kinds}, {names[0]} string, {names[1]} double")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.0) -> DataFrame:
    """The rows whose language is known with a score of `least` or more, with all their columns,
    whatever their names. Repeated rows and null ids stay; null texts and texts without a letter go."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        score = Scorer(held.value)
        for batch in batches:
            found = [score(t.as_py()) for t in batch.column(place)]
            yield batch.take(pa.array([k for k, (x, s) in enumerate(found) if x != UNKNOWN and s >= least], pa.int64()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fold that no model learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    return predict(docs, fit(docs.where(~F.col("held_out"))), ["doc_id", "held_out"])
