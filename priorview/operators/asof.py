"""Latest-per-key, top-n-per-key and as-of lookups.

Work per key stays bounded when one key holds a large share of the rows:

* ``row_number() <= n`` filters carry a partial group limit before the shuffle, so a hot key
  ships at most n rows per map task;
* running windows run over per-day aggregates, so a key has at most one row per calendar day;
* the as-of top-n first counts, then fetches only the date tiers that can reach the n rows,
  so it does not pair every request with every event of its key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import last_asof_date, month_index


def newest(col: str, nulls: str = "last") -> Column:
    """Descending order with the place of NULLs written out."""
    return F.col(col).desc_nulls_first() if nulls == "first" else F.col(col).desc_nulls_last()


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | None = None,
                  rank_col: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key with their rank; all rows without ``n``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank_col, F.row_number().over(window))
    return ranked if n is None else ranked.where(F.col(rank_col) <= n)


def latest_by(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str] = (),
              nulls: str = "last") -> DataFrame:
    """One row per key, the newest by ``order``; ``ties`` make the choice a total order."""
    by = [newest(order, nulls)] + [newest(t) for t in ties]
    return top_n_per_key(df, keys, by, 1, "_rn").drop("_rn")


def distinct_asof(requests: DataFrame, scope: Sequence[str], asof: str) -> DataFrame:
    """Each (scope, as-of date) once. Requests that share both see the same history."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*scope, asof]])
    return requests.where(known).select(*scope, asof).distinct()


def event_states(facts: DataFrame, event: str, lookback_months: int = 24) -> DataFrame:
    """Settled facts as intervals of as-of dates: visible from the day after the event until
    the lookback ends."""
    return (facts.where(F.col(event).isNotNull())
            .withColumn("valid_from", F.date_add(F.col(event), 1))
            .withColumn("valid_to", F.date_add(last_asof_date(event, lookback_months), 1)))


def asof_topn(probes: DataFrame, states: DataFrame, scope: Sequence[str], asof: str, event: str,
              order: Sequence[Column], n: int | None = None, lookback_months: int = 24,
              tier_months: int = 3) -> DataFrame:
    """Newest ``n`` states of each (scope, as-of) probe, plus the count of all visible ones;
    every visible state without ``n``.

    ``probes`` has one row per (scope, as-of). ``states`` holds the scope columns, ``event``
    (a date), ``valid_from`` and ``valid_to``: visible when valid_from <= as-of < valid_to,
    which already includes the strict as-of guard and the lookback. ``order`` is the
    tie-break among states of one event date and must be a total order.
    """
    scope = list(scope)

    def tier(day) -> Column:
        return F.floor(month_index(day) / tier_months).cast("int")

    live = states.where(F.col("valid_from") < F.col("valid_to")).withColumn("_tier", tier(event))
    tiers = F.explode(F.sequence(tier(F.add_months(F.col(asof), -lookback_months)), tier(asof)))
    visible_at = (F.col("valid_from") <= F.col(asof)) & (F.col(asof) < F.col("valid_to"))
    of_probe = Window.partitionBy(*scope, asof)
    in_order = of_probe.orderBy(newest(event), *order)
    if n is None:
        pairs = probes.select(*scope, asof, tiers.alias("_tier")).join(live, [*scope, "_tier"]).where(visible_at)
        # The rank's order is the count's order too, so rows are sorted once.
        return (pairs.withColumn("rank", F.row_number().over(in_order))
                .withColumn("total_rows", F.count(F.lit(1)).over(of_probe)).drop("_tier", "valid_from", "valid_to"))

    # 1. Visible states per (scope, tier) as a step function of the as-of date.
    changes = F.explode(F.array(F.struct(F.col("valid_from").alias("day"), F.lit(1).alias("step")),
                                F.struct(F.col("valid_to").alias("day"), F.lit(-1).alias("step"))))
    steps = (live.select(*scope, "_tier", changes.alias("c"))
             .groupBy(*scope, "_tier", F.col("c.day").alias("_day"))
             .agg(F.sum("c.step").alias("_step"))
             .withColumn("_probe", F.lit(0)))
    asked = probes.select(*scope, tiers.alias("_tier"), F.col(asof).alias("_day"),
                          F.lit(0).cast("long").alias("_step"), F.lit(1).alias("_probe"))
    timeline = (Window.partitionBy(*scope, "_tier").orderBy("_day", "_probe")
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    visible = (steps.unionByName(asked)
               .withColumn("_visible", F.sum("_step").over(timeline))
               .where((F.col("_probe") == 1) & (F.col("_visible") > 0))
               .select(*scope, "_tier", F.col("_day").alias(asof), "_visible"))

    # 2. Tiers needed to reach n rows, newest first.
    down = Window.partitionBy(*scope, asof).orderBy(F.col("_tier").desc())
    before = F.sum("_visible").over(down.rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("_visible").over(Window.partitionBy(*scope, asof))
    needed = (visible.withColumn("_before", F.coalesce(before, F.lit(0)))
              .withColumn("total_rows", total)
              .where(F.col("_before") < n)
              .select(*scope, asof, "_tier", "_before", "total_rows"))

    # 3. States that are alike in date and visibility: rows past the n-th can never be chosen.
    alike = top_n_per_key(live, [*scope, event, "valid_from", "valid_to"], order, n, "_alike")

    # 4. Rank over the tiers. The window is not on the join's keys, so the join can be split
    #    where a (scope, tier) is hot; the limit on the rank is applied to each part of it
    #    before the exchange, so a part sends at most n rows for each probe.
    pairs = needed.join(alike, [*scope, "_tier"]).where(visible_at)
    return (pairs.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= n)
            .drop("_tier", "_before", "_alike", "valid_from", "valid_to"))


def visible_sums(probes: DataFrame, states: DataFrame, scope: Sequence[str], asof: str, event: str,
                 sums: dict[str, Column]) -> DataFrame:
    """Per (scope, as-of) the number of visible states, their newest and oldest event and sums.

    A scope's states and probes meet by equi-join inside (scope, event month), whose rows are
    reduced to partial sums of each probe before they move on."""
    scope = list(scope)
    month = lambda day: month_index(day)
    live = states.where(F.col("valid_from") < F.col("valid_to"))
    # States alike in date and visibility are one row.
    alike = (live.groupBy(*scope, event, "valid_from", "valid_to")
             .agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(name) for name, c in sums.items()])
             .withColumn("_month", month(event)))
    months = F.explode(F.sequence(month(F.add_months(F.col(asof), -24)), month(asof)))
    pairs = (probes.select(*scope, asof, months.alias("_month")).join(alike, [*scope, "_month"])
             .where((F.col("valid_from") <= F.col(asof)) & (F.col(asof) < F.col("valid_to"))))
    return pairs.groupBy(*scope, asof).agg(
        F.sum("_n").alias("n_rows"), F.max(event).alias("newest"), F.min(event).alias("oldest"),
        *[F.sum(name).alias(name) for name in sums])


def asof_history(requests: DataFrame, facts: DataFrame, scope: Sequence[str], asof: str, event: str,
                 order: Sequence[Column], n: int | None = None, lookback_months: int = 24) -> DataFrame:
    """Per request the newest ``n`` facts of its scope (all without ``n``) dated strictly before
    the as-of date and within the lookback."""
    probes = distinct_asof(requests, scope, asof)
    found = asof_topn(probes, event_states(facts, event, lookback_months), scope, asof, event,
                      order, n, lookback_months)
    return requests.join(found, [*scope, asof])


def running_best(probes: DataFrame, tracks: DataFrame, keys: Sequence[str], at: str,
                 eligible: str, best: Column, out: str = "best") -> DataFrame:
    """For each probe the greatest ``best`` value among the tracks of its key whose
    ``eligible`` date is on or before the probe's ``at`` date.

    The tracks are reduced to one row per (key, eligible date) first, and the probes must be
    distinct per (key, date), so the window of a key is bounded by the calendar.
    """
    keys = list(keys)
    daily = (tracks.groupBy(*keys, F.col(eligible).alias("_day"))
             .agg(F.max(best).alias("_best"))
             .withColumn("_probe", F.lit(0)))
    asked = probes.select(*keys, F.col(at).alias("_day"), F.lit(1).alias("_probe"))
    line = (Window.partitionBy(*keys).orderBy("_day", "_probe")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (daily.unionByName(asked, allowMissingColumns=True)
            .withColumn(out, F.max("_best").over(line))
            .where(F.col("_probe") == 1)
            .select(*keys, F.col("_day").alias(at), out))
