"""Result table sink and lookup, column profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import as_result_rows


def append_results(rows: DataFrame, path: str, partition: str | None = "pricing_date") -> None:
    """Append result rows, in folders by pricing date. Rows of a date are brought together first,
    so an append adds few files; a date with many rows is split again."""
    rows = as_result_rows(rows)
    if partition is None:
        rows.write.mode("append").parquet(path)
    else:
        rows.hint("rebalance", partition).write.mode("append").partitionBy(partition).parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored rows of all versions; columns that older files lack are NULL."""
    return as_result_rows(spark.read.option("mergeSchema", "true").parquet(path))


def lookup_results(results: DataFrame, ids: DataFrame) -> DataFrame:
    """Result rows of the wanted request ids. Ids come as a table, so an empty list is fine."""
    return results.join(ids.select("request_id"), "request_id", "left_semi")


def keep_numeric_ids(ids: DataFrame, col: str) -> DataFrame:
    """Finite numeric ids, truncated to whole numbers."""
    value = F.col(col).cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return ids.where(finite).select(F.col(col).cast("double").cast("bigint").alias(col)).distinct()


def sample_rows(df: DataFrame, n: int | None = None) -> DataFrame:
    """``n`` rows to look at, whichever come first; all rows without ``n``."""
    return df if n is None else df.limit(n)


def column_profile(df: DataFrame) -> DataFrame:
    """Type, NULL count, distinct estimate, min and max of each column, in one pass."""
    aggs, rows = [], []
    for i, field in enumerate(df.schema.fields):
        name, kind = field.name, field.dataType
        plain = isinstance(kind, T.AtomicType) and not isinstance(kind, T.VariantType)
        text = lambda c: c.cast("string")
        aggs += [F.count_if(F.col(name).isNull()).alias(f"n{i}"),
                 (F.approx_count_distinct(name) if plain else F.lit(None).cast("bigint")).alias(f"d{i}"),
                 (text(F.min(name)) if plain else F.lit(None).cast("string")).alias(f"l{i}"),
                 (text(F.max(name)) if plain else F.lit(None).cast("string")).alias(f"h{i}")]
        rows.append(F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("column_name"),
                             F.lit(kind.simpleString()).alias("data_type"), F.col(f"n{i}").alias("null_count"),
                             F.col(f"d{i}").alias("distinct_estimate"), F.col(f"l{i}").alias("min_value"),
                             F.col(f"h{i}").alias("max_value")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def column_sketches(df: DataFrame, *parts: str) -> DataFrame:
    """(parts, column_name, n_rows, null_count, sketch): for each part of a table and each other
    column a distinct-count sketch that adds up, to be kept beside the table."""
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("_value"))
                               for c in df.columns if c not in parts]))
    return df.select(*parts, cells).groupBy(*parts, "column_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("_value").isNull()).alias("null_count"),
        F.hll_sketch_agg("_value").alias("sketch"))


def merged_profile(sketches: DataFrame) -> DataFrame:
    """(column_name, n_rows, null_count, distinct_estimate) of the parts together. The estimate is
    usually within 2 % of the exact count; the table itself is not read again."""
    return sketches.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("null_count").alias("null_count"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_estimate"))
