"""SimHash near-duplicates by tiled exact comparison."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, stored, table
from .components import connected, forest

SEED = 42      # fixed value: the hash seed of a shingle
TILE = 2048    # most fingerprints of a tile
STRIP = 128    # fingerprints of a tile that meet another tile at once
BITS = 64


def fingerprint(text: str | None, shingle: int, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles, as a signed integer; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in
                       zip(start[:len(words) - k + 1].tolist(), end[k - 1:].tolist())], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype(">u8").view(np.uint8)
        ones += np.unpackbits(part).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0].astype(np.uint64).view(np.int64))


def _text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      shingle: int = 4) -> DataFrame:
    """(id, key, fp) for every row, key being the text's MD5. Null and blank texts have
    fingerprint zero."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["id", "key", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), _text_key(text).alias("key"), text.alias("text")).mapInArrow(
        run, f"id {kind}, key string, fp long")


def _masks(radius: int, agree: int) -> list[int]:
    """Bit masks such that fingerprints within the radius are equal under one of them at least:
    the bits fall into radius + agree blocks, of which radius differing bits spare `agree`."""
    n = radius + agree
    cuts = [BITS * k // n for k in range(n + 1)]
    blocks = [((1 << cuts[k + 1]) - (1 << cuts[k])) for k in range(n)]
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    return [signed(sum(c)) for c in combinations(blocks, agree)]


def agreeing_blocks(n: int, radius: int, pair_cost: float = 1e-3) -> int:
    """How many blocks must agree, from the number of fingerprints: more blocks give smaller
    groups and more of them. The choice changes the work, never the result."""
    def cost(m: int) -> float:
        groups = comb(radius + m, m)
        return groups * (n + pair_cost * n * n / 2 / 2 ** (BITS * m / (radius + m)))
    return min(range(1, 7), key=cost)


def _close(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two tiles within the radius: exclusive-or and bit counts, in strips. Both
    tiles stand in the order of their population counts, and a strip meets only those whose
    counts are within the radius of its own."""
    first, second = (np.argsort(np.bitwise_count(x), kind="stable") for x in (a, b))
    a, b = a[first], b[second]
    ones, others = np.bitwise_count(a).astype(np.int64), np.bitwise_count(b).astype(np.int64)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, len(a), STRIP):
        end = min(at + STRIP, len(a))
        low, high = np.searchsorted(others, [ones[at] - radius, ones[end - 1] + radius + 1])
        i, j = np.nonzero(np.bitwise_count(a[at:end, None] ^ b[None, low:high]) <= radius)
        left.append(first[i + at])
        right.append(second[j + low])
    return np.concatenate(left), np.concatenate(right)


def _stars(batches, radius: int):
    """Rows (a, b) of two tiles (b null: the tile with itself) -> edges that connect what the
    tiles' links connect, at most one for each fingerprint."""
    for batch in batches:
        us, vs = [], []
        lists = [batch.column(k) for k in range(2)]
        for row in range(batch.num_rows):
            a = lists[0][row].values.to_numpy(zero_copy_only=False)
            if lists[1][row].is_valid:
                b = lists[1][row].values.to_numpy(zero_copy_only=False)
                i, j = _close(a, b, radius)
                points, j = np.concatenate([a, b]), j + len(a)
            else:
                i, j = _close(a, a, radius)
                points, (i, j) = a, (i[i < j], j[i < j])
            if not len(i):
                continue
            root = forest(len(points), i, j)
            moved = np.nonzero(root != np.arange(len(points)))[0]
            us.append(points[moved])
            vs.append(points[root[moved]])
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])


def _tiles(fps: DataFrame, masks: list[int], radius: int, tile: int) -> list[DataFrame]:
    """Rows (a, b) of tiles to be compared (b null: the tile with itself) such that all pairs of
    distinct `fp` that are equal under a mask and within the radius meet.

    Fingerprints are grouped by the bits under each mask; a group of up to `tile` is compared
    whole. A larger one is cut into tiles by population count and a hash; pairs of tiles whose
    counts differ beyond the radius are skipped, and the others are separate rows, so no task
    holds more than two tiles at once.
    """
    keyed = stored(fps.select("fp", F.bit_count("fp").cast("int").alias("ones"),
                              F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "key")),
                   "simhash-keys")
    counts = keyed.groupBy("mask", "key", "ones").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("mask", "key").agg(F.sum("n").alias("total")).where("total > 1")

    whole = (keyed.join(sizes.where(F.col("total") <= tile), ["mask", "key"])
             .groupBy("mask", "key").agg(F.collect_list("fp").alias("a")).select("a"))
    whole = whole.withColumn("b", F.lit(None).cast(whole.schema["a"].dataType))

    # Tiles of the large groups: (mask, key, ones, part).
    large = stored(counts.join(sizes.where(F.col("total") > tile), ["mask", "key"])
                   .withColumn("parts", F.ceil(F.col("n") / F.lit(tile)).cast("int")).drop("n", "total"), "simhash-large")
    named = large.select("mask", "key", "ones", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    tiles = (keyed.join(large, ["mask", "key", "ones"])
             .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
             .groupBy("mask", "key", "ones", "part").agg(F.collect_list("fp").alias("fps")))
    tiles = stored(tiles, "simhash-tiles")
    other = named.select("mask", "key", F.col("ones").alias("ones2"), F.col("part").alias("part2"))
    pairs = (named.join(other, ["mask", "key"])
             .where((F.col("ones2") - F.col("ones")).between(0, radius)
                    & ((F.col("ones") < F.col("ones2")) | (F.col("part") <= F.col("part2")))))
    split = (pairs.join(tiles.withColumnRenamed("fps", "a"), ["mask", "key", "ones", "part"])
             .join(tiles.select("mask", "key", F.col("ones").alias("ones2"), F.col("part").alias("part2"),
                                F.col("fps").alias("b")), ["mask", "key", "ones2", "part2"])
             .select("a", F.when((F.col("ones") != F.col("ones2")) | (F.col("part") != F.col("part2")),
                                 F.col("b")).alias("b")))
    return [whole, split]


def links(fps: DataFrame, radius: int = 4, agree: int | None = None, tile: int = TILE) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of `fp` within the radius.

    `fps` has distinct fingerprints; repeated ones are harmless. A pair of tiles returns a
    spanning forest of its links instead of all of them.
    """
    masks = _masks(radius, agree or agreeing_blocks(fps.count(), radius))
    run = lambda batches: _stars(batches, radius)
    whole, split = _tiles(fps, masks, radius, tile)
    return whole.mapInArrow(run, "u long, v long").unionAll(split.mapInArrow(run, "u long, v long"))


def _components(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, agree: int | None,
                tile: int) -> tuple[DataFrame, DataFrame]:
    """Stored (id, key, fp) of every row, and (fp, root) of every distinct fingerprint."""
    marked = stored(with_fingerprints(docs, id_col, text_col, shingle), "simhash-fps")
    fps = stored(marked.select("fp").distinct(), "simhash-distinct")
    roots = connected(links(fps, radius, agree, tile)).withColumnRenamed("node", "fp")
    return marked, stored(fps.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "simhash-roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    radius: int = 4, agree: int | None = None, tile: int = TILE) -> DataFrame:
    """(id, fp, component): every row with its fingerprint and the smallest id reachable over
    links of `radius` or fewer differing bits, its own included.

    Equal fingerprints meet once, so a group of exact copies costs one entry whatever its size.
    Null and blank texts have fingerprint zero and link like any other. A null id never becomes
    a component unless all ids of the component are null. Repeated rows stay. Other columns are
    not read. An empty table gives no rows.
    """
    marked, fps = _components(docs, id_col, text_col, shingle, radius, agree, tile)
    first = marked.groupBy("fp").agg(F.min("id").alias("first")).join(fps, "fp")
    low = first.groupBy("root").agg(F.min("first").alias("component"))
    named = fps.join(low, "root").select("fp", "component")
    return marked.join(named, "fp").select("id", "fp", "component")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                            radius: int = 4, agree: int | None = None, tile: int = TILE) -> DataFrame:
    """The documents with one of each group that links of `radius` or fewer differing bits connect:
    that of the smallest id (nulls last), then of the smallest MD5 of the text; of rows equal in
    both, one. Null and blank texts have fingerprint zero and link like any other. All columns
    stay, whatever their names; an empty table stays empty.
    """
    marked, fps = _components(docs, id_col, text_col, shingle, radius, agree, tile)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    winners = marked.groupBy("fp").agg(F.min(order).alias("best")).join(fps, "fp").groupBy("root").agg(F.min("best").alias("best"))
    key, ident = fresh(docs, "near_key", "near_id")
    winners = winners.select(F.col("best.key").alias(key), F.col("best.id").alias(ident))
    rows = docs.withColumns({key: _text_key(F.col(text_col)), ident: F.col(id_col)})
    same = (rows[key] == winners[key]) & rows[ident].eqNullSafe(winners[ident])
    return rows.join(winners, same, "left_semi").dropDuplicates([key, ident]).drop(key, ident)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))
