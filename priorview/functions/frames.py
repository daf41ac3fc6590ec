"""DataFrame helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds costly columns (parsed JSON, a long CASE) so that later steps read their values.

    The optimizer copies a plain alias into every expression and filter that uses it, which
    would parse the same text once per use. A generator's output is not copied.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))
