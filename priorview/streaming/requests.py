"""Request feed as a stream, the result sink, and outcomes that arrive weeks later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.asof import latest_by
from ..sources import commits as cm

# Fixed value: flush interval of the source's sink.
FLUSH_SECONDS = 5
ID_BUCKETS = 256


def request_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "json",
                   max_files: int = 1000, **options: str) -> DataFrame:
    """Files of a folder as a stream; ``max_files`` bounds one micro-batch."""
    return (spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files)
            .options(**options).load(path))


def first_posts(stream: DataFrame, key: str, event_time: str, replay_delay: str) -> DataFrame:
    """One row per request id among posts at most ``replay_delay`` apart. Leave it out to keep
    the source's behaviour, where a repeated post gives repeated rows."""
    return stream.withWatermark(event_time, replay_delay).dropDuplicatesWithinWatermark([key])


def start_sink(rows: DataFrame, path: str, checkpoint: str, partition: str | None = None,
               once: bool = False) -> StreamingQuery:
    """Append a stream to parquet. The file sink commits each micro-batch in its own log, so a
    batch that is run again after a failure adds nothing twice."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition:
        writer = writer.partitionBy(partition)
    trigger = {"availableNow": True} if once else {"processingTime": f"{FLUSH_SECONDS} seconds"}
    return writer.trigger(**trigger).start(path)


def id_bucket(key: str, buckets: int = ID_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def append_new(rows: DataFrame, path: str, batch: str, key: str = "request_id", buckets: int = ID_BUCKETS) -> bool:
    """Append the rows whose ``key`` the table does not hold yet, one for each, under a batch id.

    The table is one of `sources.commits`, so streams and batch jobs append to the same one, and
    a batch that is run again adds nothing. However old the stored row is, a repeat adds none:
    the batch meets the stored keys, of which only its own buckets are read. Nothing is kept in
    stream state. Batches of one table must not run at once, else both may add a key, and use
    the same number of buckets. Rows without a key are appended as they are.
    """
    known = rows.where(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("id_bucket", id_bucket(key, buckets))
    spark, schema = rows.sparkSession, known.schema
    records = cm.live(cm.commits(spark, path))
    if any(r["id"] == batch for r in records):
        return False
    if records:
        # Partition values of the batch, `buckets` at most.
        own = [r[0] for r in known.select("id_bucket").distinct().collect()]
        stored = cm.read(spark, path, schema).where(F.col("id_bucket").isin(own)).select("id_bucket", key)
        known = known.join(stored, ["id_bucket", key], "left_anti").select(*schema.names)
    bare = rows.where(F.col(key).isNull()).withColumn("id_bucket", F.lit(0))
    return cm.append(known.unionByName(bare), path, batch, "id_bucket")


def read_new(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows that `append_new` stored."""
    whole = StructType([*schema.fields, StructField("id_bucket", IntegerType())])
    return cm.read(spark, path, whole).drop("id_bucket")


def start_table(rows: DataFrame, path: str, checkpoint: str, name: str, key: str = "request_id", buckets: int = ID_BUCKETS,
                once: bool = False) -> StreamingQuery:
    """Append a stream to such a table, a micro-batch at a time. The batch id is that of the stream's
    checkpoint, so what runs again after a failure is known by its record. The source's options
    bound a micro-batch's rows, the trigger its waiting time."""
    trigger = {"availableNow": True} if once else {"processingTime": f"{FLUSH_SECONDS} seconds"}
    return (rows.writeStream.foreachBatch(lambda part, k: append_new(part, path, f"{name}-{k}", key, buckets) and None)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def open_requests(results: DataFrame, scored: DataFrame) -> DataFrame:
    """Requests that have result rows but no score yet."""
    return results.join(scored.select("request_id"), "request_id", "left_anti")


def rescore_open(results: DataFrame, outcomes: DataFrame, scored: DataFrame, order: str = "outcome_at",
                 ties: tuple[str, ...] = ()) -> DataFrame:
    """Scheduled form of the late-outcome join: open requests that now have an outcome, each
    with its latest one. Waiting needs no stream state, however long it takes."""
    return open_requests(results, scored).join(latest_by(outcomes, ["request_id"], order, ties), "request_id")


def join_late_outcomes(results: DataFrame, outcomes: DataFrame, result_time: str = "priced_at",
                       outcome_time: str = "outcome_at", max_delay: str = "28 days",
                       lateness: str = "1 day") -> DataFrame:
    """Stream-stream form: an outcome meets the result row of its request when it comes within
    ``max_delay`` of it; that bounds the state. All outcomes of a request meet it."""
    left = results.withWatermark(result_time, lateness)
    right = outcomes.withWatermark(outcome_time, lateness).withColumnRenamed("request_id", "_outcome_of")
    near = ((F.col(outcome_time) >= F.col(result_time))
            & (F.col(outcome_time) <= F.col(result_time) + F.expr(f"INTERVAL {max_delay}")))
    return left.join(right, (F.col("request_id") == F.col("_outcome_of")) & near).drop("_outcome_of")
