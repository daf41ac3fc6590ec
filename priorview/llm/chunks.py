"""Document fingerprints from content-defined chunks."""

from __future__ import annotations

import hashlib
from collections import deque

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LEAST, USUAL, MOST = 32, 96, 384  # bytes of a chunk
WINDOW = 32                       # bytes that a boundary depends on


def _gear() -> np.ndarray:
    """A 32-bit number for each byte value, from a hash of the value."""
    return np.array([xxhash.xxh32_intdigest(bytes([k]), 7) for k in range(256)], np.uint32)


GEAR = _gear()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: h = 2h + gear[byte] modulo 2^32. A byte's part is shifted
    out after 32 steps, so the sum over a window builds up by doubling its width."""
    h, width = GEAR[data], 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)  # the right side is copied before it is added
        width *= 2
    return h


def _masks(least: int, usual: int) -> tuple[np.uint32, np.uint32]:
    """Masks of the high bits: two bits stricter before the usual size, two looser after it."""
    bits = max(3, (usual - least).bit_length())
    high = lambda n: np.uint32(((1 << n) - 1) << (32 - n))
    return high(bits + 1), high(bits - 2)


def chunks(data: bytes, least: int = LEAST, usual: int = USUAL, most: int = MOST) -> list[tuple[int, int]]:
    """(start, end) of the chunks of data, in order and without gaps."""
    out, start, n = [], 0, len(data)
    if n <= least:
        return [(0, n)] if n else []
    hard, soft = _masks(least, usual)
    h = gear_hashes(np.frombuffer(data, np.uint8))
    at = np.nonzero((h & soft) == 0)[0]
    strict = ((h[at] & hard) == 0).tolist()
    at = (at + 1).tolist()  # a chunk ends after the byte
    k, m = 0, len(at)
    while start < n:
        end = min(start + most, n)
        while k < m and at[k] < start + least:
            k += 1
        j = k
        while j < m and at[j] < end:
            if strict[j] or at[j] >= start + usual:
                end = at[j]
                break
            j += 1
        out.append((start, end))
        start, k = end, j
    return out


def digests(text: str, **sizes: int) -> dict[str, int]:
    """Digest -> length of the distinct chunks of the text's UTF-8 bytes."""
    data = text.encode("utf-8", "surrogatepass")
    return {xxhash.xxh64_hexdigest(data[a:b]): b - a for a, b in chunks(data, **sizes)}


def to_text(fingerprint: dict[str, int]) -> str:
    return ",".join(f"{d}:{n}" for d, n in sorted(fingerprint.items()))


def containment(a: dict[str, int], b: dict[str, int]) -> float:
    """Share of a's length in chunks that b has; between empty sets 1, of an empty set else 0."""
    if not a:
        return float(not b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def edited(text: str, other: str) -> str:
    """The text with its last half replaced by the first as many characters of the other."""
    half = len(text) // 2
    return text[:len(text) - half] + other[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """(id, fingerprint) of every row: digest:length of each distinct chunk, in order of digests.

    Boundaries are where the gear hash of the last 32 bytes has zeros under a mask, so an
    insertion moves only the chunks around it. The mask is stricter before the usual size and
    looser after it. Null and empty texts have an empty fingerprint. Equal texts have equal
    fingerprints. Rows are independent: no shuffle.
    """

    def run(batches):
        for batch in batches:
            out = [to_text(digests(t.as_py() or "", **sizes)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, fingerprint string")


def _followed(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """Rows (part, id, text, tail) such that, inside a part, each row but the tails is followed,
    in descending (id, text), by its next row. Parts are ranges of ids; a tail is the first row
    of the next part that has rows (of the first after the last), sent along as its copy.

    Only ids decide the ranges, from a sketch of their quantiles, and the first id of each
    part, as many as there are parts, is all that is broadcast.
    """
    ident = F.col(id_col).cast("long")
    cuts = docs.select(F.percentile_approx(ident, [k / parts for k in range(parts)], 10_000)).first()[0]
    cuts = sorted(set(cuts or []))[1:]
    # The number of cuts at or below the id, by halving steps; null ids come last, below all.
    lower = F.lit(0)
    if cuts:
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
        bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
        lower = F.aggregate(steps, F.lit(0), lambda n, s: n + F.when(ident >= F.get(bounds, n + s - 1), s).otherwise(0))
    rows = docs.select(F.when(ident.isNull(), -1).otherwise(lower).alias("part"), ident.alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    heads = sorted((r["part"], r["id"]) for r in rows.groupBy("part").agg(F.max("id").alias("id")).collect())
    if not heads:
        return rows.withColumn("tail", F.lit(False))
    # A part's head is also the tail of the part above it, the highest one's that of the lowest.
    above = [(p, heads[(k + 1) % len(heads)][0]) for k, (p, _) in enumerate(heads)]
    ids = dict(heads)
    spark = docs.sparkSession
    tails = spark.createDataFrame([(p, ids[p], a) for p, a in above], "part int, id long, above int")
    copies = (rows.join(F.broadcast(tails), (rows["part"] == tails["part"]) & rows["id"].eqNullSafe(tails["id"]))
              .select(F.col("above").alias("part"), rows["id"], "text", F.lit(True).alias("tail")))
    return rows.withColumn("tail", F.lit(False)).unionAll(copies)


def compare_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None,
                 **sizes: int) -> DataFrame:
    """Each row with its fingerprint, that of its edited text, and its likeness to both the
    edited text and the next document: (id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next).

    The next document is the one of next smaller id; the last is followed by the first. Rows of
    equal id follow each other in descending order of text; a null id comes last. A single row
    follows itself. Null and empty texts are empty. Texts are shuffled once, by ranges of ids,
    and read in order, two at a time. Only the two named columns are read. Ids are integers.
    An empty table gives no rows.
    """
    parts = parts or max(2, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = _followed(docs, id_col, text_col, parts)

    def run(batches):
        waiting: deque = deque()  # the row before, not yet followed
        for batch in batches:
            out = []
            for part, i, text, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = digests(text, **sizes) if waiting or not tail else None
                if waiting and waiting[0][0] == part:
                    _, j, before, fp = waiting.popleft()
                    changed = edited(before, text)
                    other = digests(changed, **sizes)
                    out.append((j, len(before), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                                to_text(fp), to_text(other), containment(fp, other), containment(fp, own)))
                waiting.clear()
                if not tail:
                    waiting.append((part, i, text, own))
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             ["id", "n_chars", "sha", "fp", "efp", "near", "next"])

    ordered = rows.repartition(parts, "part").sortWithinPartitions(
        F.desc("part"), F.asc("tail"), F.desc_nulls_last("id"), F.desc("text"))
    return ordered.mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, "
                                   "edited_fingerprint string, near_edited double, near_next double")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_next(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
