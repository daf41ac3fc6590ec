"""Line deduplication over levelled sorted runs of line hashes. Built-in expressions only."""

from __future__ import annotations

import uuid
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorview.functions.frames import computed_once

from .common import fresh, shared_dir, stored, table

BLANKS = " \t\n\v\f\r"   # fixed value: stripped at both ends of a line
LEAST = 10               # fixed value: shorter keys are never dropped
LAST_ID = (1 << 63) - 1  # place of a null id: after all others


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case and nothing else changed."""
    key = F.btrim(line, F.lit(BLANKS))
    plain = F.octet_length(key) == F.char_length(key)
    return F.when(plain, F.lower(key)).otherwise(F.translate(key, ascii_uppercase, ascii_lowercase))


class LineRuns:
    """Sorted runs of (h1, h2, owner), one row for each line hash, in levels.

    A run is a table bucketed and sorted by the hash, so a batch is joined to it without moving
    the run. When a level holds `fanout` runs, the next batch first merges them into one run of
    the level above; a hash is thus rewritten once per level. Runs are disjoint, and batches
    must come in ascending order of ids for the owner to be the smallest one.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.made: list[str] = []

    def _write(self, run: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        (run.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
         .option("path", f"{shared_dir(self.spark)}/{name}").saveAsTable(name))
        self.made.append(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def compact(self) -> None:
        """Merge every level that is full into the next."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                names, self.levels[level] = self.levels[level], []
                merged = self.spark.table(names[0])
                for name in names[1:]:
                    merged = merged.unionAll(self.spark.table(name))
                self._write(merged.repartition(self.buckets, "h1", "h2"), level + 1)
            level += 1

    def add(self, lines: DataFrame) -> DataFrame:
        """(id, h1, h2) of a batch -> (h1, h2, owner) of its hashes that a smaller id than some
        id of the batch holds. The batch's new hashes become a run of the lowest level."""
        self.compact()
        own = lines.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        old = []
        for name in (name for level in self.levels for name in level):
            old.append(f"owner{len(old)}")
            own = own.join(self.spark.table(name).withColumnRenamed("owner", old[-1]), ["h1", "h2"], "left")
        known = F.coalesce(*old) if old else F.lit(None).cast("long")
        own = stored(own.select("h1", "h2", "first", "last", known.alias("known")), "line-owners")
        self._write(own.where("known is null").select("h1", "h2", F.col("first").alias("owner"))
                    .repartition(self.buckets, "h1", "h2"), 0)
        return own.where("known is not null or last > first").select(
            "h1", "h2", F.coalesce("known", "first").alias("owner"))

    def close(self) -> None:
        """Forget the tables. Their files stay in the shared folder."""
        for name in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 4,
                fanout: int = 2, counts: bool = True) -> DataFrame:
    """Documents without the lines that a document of smaller id holds; `counts` adds n_lines and
    n_dropped.

    Texts split at newlines; null and empty texts are one empty line and become empty texts.
    Lines compare by `line_key`; keys under ten code points are never dropped, and all lines of
    the smallest id that holds a key stay. Rows of equal id are one document. A null id comes
    after all others. Ids are integers. Other columns pass through; n_lines and n_dropped are
    replaced where they exist. An empty table gives no rows.

    The lines are hashed in one pass (128 bits, whose chance of a collision is below one in a
    million for 10^16 lines) and laid down in `batches` ranges of ids. Each batch is joined to the runs of the earlier ones.
    Only hashes and positions move; the texts move once, when the dropped positions are joined
    back. A frequent line is one row of a run and a partial aggregate of a batch, and its rows
    in the final join are an ordinary join's, which adaptive execution splits.
    """
    spark = docs.sparkSession
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))
    text = F.coalesce(F.col(text_col), F.lit(""))
    cuts = docs.select(F.percentile_approx(ident, [k / batches for k in range(batches)], 1000)).first()[0]
    cuts = sorted(set(cuts or []))[1:]
    batch = sum((F.when(F.col("id") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    whole = docs.select(ident.alias("id"), F.xxhash64(text).alias("row"),
                        F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keyed = computed_once(whole.select("id", "row", "pos", "line"), key=line_key(F.col("line"))).where(F.char_length("key") >= LEAST)
    lines = keyed.select("id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"),
                         batch.alias("batch"))
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("id long, row long, pos int, h1 long, h2 long, batch int").parquet(path)

    runs, dropped = LineRuns(spark, fanout), None
    for k in range(len(cuts) + 1):
        part = lines.where(F.col("batch") == k).drop("batch")
        repeated = runs.add(part)
        found = part.join(repeated, ["h1", "h2"]).where("id > owner").select("id", "row", "pos")
        dropped = found if dropped is None else dropped.unionAll(found)
    runs.close()

    key, row, gone, parts = fresh(docs, "line_id", "line_row", "line_gone", "line_parts")
    dropped = dropped.groupBy(F.col("id").alias(key), F.col("row").alias(row)).agg(F.collect_set("pos").alias(gone))
    out = docs.withColumns({key: ident, row: F.xxhash64(text)}).join(dropped, [key, row], "left")
    out = computed_once(out, **{parts: F.split(text, "\n", -1)})
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    kept = F.when(F.col(gone).isNull(), text).otherwise(
        F.array_join(F.transform(stay, lambda i: F.col(parts)[i]), "\n"))
    new = {"n_lines": F.size(parts).cast("long"), "n_dropped": F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")}
    return out.withColumns({text_col: kept, **(new if counts else {})}).drop(key, row, gone, parts)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = f"""
WITH rows AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
    SELECT doc_id, r, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM rows
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        '{ascii_uppercase}', '{ascii_lowercase}') AS key FROM lines
), owners AS (
    SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= {LEAST} GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
    SELECT k.doc_id, k.r, k.line, k.pos, o.owner IS NOT NULL AND k.doc_id > o.owner AS gone
    FROM keyed k LEFT JOIN owners o ON k.key = o.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id, r
"""
