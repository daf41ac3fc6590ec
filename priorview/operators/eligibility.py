"""Eligibility: latest track as of a date, accumulators, benefit tiles, source choice, gate."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import computed_once, date_prefix, try_number
from .asof import running_best

# Note prefix of a successful check, and the 271 codes of the accumulators.
SUCCESS_NOTE = "<b class=successtext"
BENEFITS = {"deduct": "C", "oop": "G"}
LEVELS = {"ind": "IND", "fam": "FAM"}
PERIODS = {"total_preferred": "25", "total_fallback": "23", "total_fallback_2": "22",
           "remaining": "29", "met": "24"}
OUTPUT_NAME = {"deduct": "deductible", "oop": "oop_max"}
PLAN_LEVEL_STC = "30"


def usable_tracks(tracks: DataFrame) -> DataFrame:
    """Tracks that answered well and hold a payload, with their two dates."""
    return (tracks.where(F.startswith("verificationnote", F.lit(SUCCESS_NOTE))
                         & F.col("incomingtransaction").isNotNull())
            .select("contextid", "patientinsuranceid", "eligibilitytrackid", "createddatetime",
                    date_prefix("dateofservicedatetime").alias("serves_on"),
                    F.col("createddatetime").cast("date").alias("created_on"))
            .where(F.col("serves_on").isNotNull() & F.col("created_on").isNotNull()))


def latest_track(lines: DataFrame, tracks: DataFrame, service_date: str, asof: str | None = None,
                 grace_days: int = 30) -> DataFrame:
    """Adds ``eligibilitytrackid`` and ``createddatetime`` of the latest track of each line.

    A track counts when its service date is on or before the line's date and it was created
    less than ``grace_days`` after that date. Without ``asof`` that is all (the source's rule,
    which lets a track in that was created after the pricing date). With ``asof`` the track
    must also have been created before that date.

    Both conditions of the source are lower bounds on the line's date, so they fold into one
    eligible-from date and a running maximum answers them. With ``asof``, tracks created by
    the line's date come from such a maximum too, and only the few days after it are looked
    up one by one.
    """
    keys = ["contextid", "patientinsuranceid"]
    good = usable_tracks(tracks)
    best = F.struct("createddatetime", "eligibilitytrackid")
    at = [*keys, service_date]
    days = lines.where(F.col("patientinsuranceid").isNotNull()).select(*at).distinct()
    if asof is None:
        eligible = good.withColumn("_from", F.greatest("serves_on", F.date_sub("created_on", grace_days - 1)))
        found = running_best(days, eligible, keys, service_date, "_from", best)
        joined = lines.join(found, at, "left")
    else:
        eligible = good.withColumn("_from", F.greatest("serves_on", "created_on"))
        early = running_best(days, eligible, keys, service_date, "_from", best, "_early")
        last_day = F.least(F.date_add(F.col(service_date), grace_days - 1), F.date_sub(F.col(asof), 1))
        next_day = F.date_add(F.col(service_date), 1)
        # A day between the line's date and the as-of date can hold a later track. The months
        # of those days, two or so, are the join's keys; the days themselves its condition.
        month = lambda day: F.trunc(day, "month")
        open_days = (lines.where(F.col("patientinsuranceid").isNotNull() & (last_day >= next_day))
                     .select(*at, asof, next_day.alias("_first"), last_day.alias("_last")).distinct()
                     .withColumn("_month", F.explode(F.sequence(month("_first"), month("_last"), F.expr("INTERVAL 1 MONTH")))))
        per_day = (good.groupBy(*keys, "created_on", "serves_on").agg(F.max(best).alias("_best"))
                   .withColumn("_month", month("created_on")))
        late = (open_days.join(per_day, [*keys, "_month"])
                .where(F.col("created_on").between(F.col("_first"), F.col("_last")) & (F.col("serves_on") <= F.col(service_date)))
                .groupBy(*at, asof).agg(F.max("_best").alias("_late")))
        joined = (lines.join(early, at, "left").join(late, [*at, asof], "left")
                  .withColumn("best", F.greatest("_early", "_late")).drop("_early", "_late"))
    return (joined.withColumn("eligibilitytrackid", F.col("best.eligibilitytrackid"))
            .withColumn("createddatetime", F.col("best.createddatetime")).drop("best"))


def ledger_with_eligibility(history: DataFrame, tracks: DataFrame, benefits: DataFrame, asof: str | None = "asof",
                            grace_days: int = 30) -> DataFrame:
    """Ledger lines of ``ledger_history`` with their latest track, the payload it came with, plan
    text and the accumulators of that track. Without ``asof`` tracks are chosen as the source does."""
    lines = history.withColumnRenamed("context_id", "contextid")
    out = latest_track(lines, tracks, "claimservicedate", asof=asof, grace_days=grace_days)
    # What a track brings is put together first, so the lines meet it once, and on a key that spreads
    # the many lines without a track.
    payload = tracks.select("contextid", "patientinsuranceid", "eligibilitytrackid", "incomingtransaction")
    return out.join(with_plan_benefits(payload, benefits), ["contextid", "patientinsuranceid", "eligibilitytrackid"], "left")


def plan_descriptions(benefits: DataFrame) -> DataFrame:
    return (benefits.where(F.col("plancoveragedesc").isNotNull())
            .groupBy("eligibilitytrackid", "contextid")
            .agg(F.max("plancoveragedesc").alias("plancoveragedesc")))


def accumulators(benefits: DataFrame, scale: int = 0) -> DataFrame:
    """Deductible and out-of-pocket totals, remaining and met, per track.

    Totals come from the first period that has one. An unknown network is dropped with the
    out-of-network rows. ``scale=0`` rounds cents away as the source does.
    """
    amount = try_number("monetaryamount", scale)
    plan = benefits.where(
        (F.col("servicetypecode") == PLAN_LEVEL_STC) & F.col("benefitinfo").isin(*BENEFITS.values())
        & (F.col("plannetwork") != "N") & F.col("timeperiodtype").isin(*PERIODS.values())
        & F.col("coveragelevel").isin(*LEVELS.values()) & amount.isNotNull())
    cells = {}
    for benefit, code in BENEFITS.items():
        for level, level_code in LEVELS.items():
            for period, period_code in PERIODS.items():
                hit = ((F.col("benefitinfo") == code) & (F.col("coveragelevel") == level_code)
                       & (F.col("timeperiodtype") == period_code))
                cells[f"{level}_{benefit}_{period}"] = F.max(F.when(hit, amount))
    pivot = (plan.groupBy("eligibilitytrackid", "contextid")
             .agg(*[value.alias(name) for name, value in cells.items()]))
    out: list[Column] = []
    for benefit in BENEFITS:
        for level in LEVELS:
            name = f"{level}_{OUTPUT_NAME[benefit]}"
            ladder = [f"{level}_{benefit}_{p}" for p in ("total_preferred", "total_fallback", "total_fallback_2")]
            out += [F.coalesce(*ladder).alias(f"{name}_total"),
                    F.col(f"{level}_{benefit}_remaining").alias(f"{name}_remaining"),
                    F.col(f"{level}_{benefit}_met").alias(f"{name}_met")]
    return pivot.select("eligibilitytrackid", "contextid", *out)


def with_plan_benefits(lines: DataFrame, benefits: DataFrame, context: str = "contextid") -> DataFrame:
    """Lines with plan description and accumulators of their track, where there are any."""
    plan = plan_descriptions(benefits).join(accumulators(benefits), ["eligibilitytrackid", "contextid"], "full")
    return lines.join(plan.withColumnRenamed("contextid", context), ["eligibilitytrackid", context], "left")


def _kind(variant: Column) -> Column:
    return F.coalesce(F.schema_of_variant(variant), F.lit("VOID"))


def _text(variant: Column, path: str) -> Column:
    """Scalar at a path as text; NULL for absent, JSON null and empty text."""
    value = F.try_variant_get(variant, path, "string")
    return F.when(value != "", value)


def forwarded_tiles(requests: DataFrame, request_id: str = "request_id", eligibility: str = "eligibility",
                    ) -> DataFrame:
    """Tiles of the eligibility a caller sent along: (request, pos, stc, response).

    Takes an array of entries or an object with a ``results`` array. An entry counts when its
    response is an object with a ``benefitsInformation`` array and its service type is not
    empty. Service types are not deduplicated: one may come for several places of service.
    """
    whole = F.col(eligibility)
    entries = F.when(_kind(whole).startswith("ARRAY"), whole).otherwise(F.try_variant_get(whole, "$.results", "variant"))
    exploded = (computed_once(requests, _entries=entries).select(request_id, "_entries")
                .where(_kind(F.col("_entries")).startswith("ARRAY"))
                .lateralJoin(_explode("_entries")))
    response = F.try_variant_get(F.col("value"), "$.response", "variant")
    benefits = F.try_variant_get(response, "$.benefitsInformation", "variant")
    return (exploded.where(_kind(benefits).startswith("ARRAY"))
            .select(request_id, F.col("pos").cast("int").alias("pos"),
                    _text(F.col("value"), "$.stc").alias("stc"), response.alias("response"))
            .where(F.col("stc").isNotNull()))


def _explode(col: str) -> DataFrame:
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    return spark.tvf.variant_explode(F.col(col).outer())


def tile_group_number(response: Column, with_plan: bool = True) -> Column:
    subscriber = _text(response, "$.subscriber.groupNumber")
    return F.coalesce(subscriber, _text(response, "$.planInformation.groupNumber")) if with_plan else subscriber


def choose_tiles(forwarded: DataFrame, own: DataFrame, labels: tuple[str, str] = ("forwarded", "self"),
                 classify: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All tiles of a request from the forwarded set if it has any, otherwise from its own
    checks. ``own`` has (request_id, pos, stc, ok, response, error), or is what ``classify`` makes
    them from; then only the checks that count are parsed. Ids drawn out of parsed texts look far fewer
    bytes to Spark than they are; the hints keep them out of the driver."""
    sent = forwarded.select("request_id", "pos", "stc", F.lit(True).alias("ok"), "response",
                            F.lit(None).cast("string").alias("error"), F.lit(labels[0]).alias("eligibility_source"))
    rest = own.hint("merge").join(forwarded.select("request_id").distinct().hint("merge"), "request_id", "left_anti")
    rest = (classify(rest) if classify else rest).select("request_id", "pos", "stc", "ok", "response", "error",
                                                         F.lit(labels[1]).alias("eligibility_source"))
    return sent.unionByName(rest)


def group_numbers(requests: DataFrame, tiles: DataFrame, forwarded_label: str = "forwarded") -> DataFrame:
    """Group number per request. Forwarded: first tile that names one (subscriber, then plan),
    then the request. Own: the request, then the subscriber of the first good plan-level tile."""
    sent = F.col("eligibility_source") == forwarded_label
    any_group = tile_group_number(F.col("response"))
    plan_tile = F.col("ok") & (F.col("stc") == PLAN_LEVEL_STC)
    per_request = tiles.groupBy("request_id").agg(
        F.min(F.when(sent & any_group.isNotNull(), F.struct("pos", any_group.alias("g")))).alias("_sent"),
        F.min(F.when(~sent & plan_tile,
                     F.struct("pos", tile_group_number(F.col("response"), False).alias("g")))).alias("_own"))
    asked = F.when(F.col("group_number") != "", F.col("group_number"))
    return (requests.select("request_id", "group_number").join(per_request, "request_id", "left")
            .select("request_id", F.coalesce(F.col("_sent.g"), asked, F.col("_own.g")).alias("group_number")))


def tile_benefits(tiles: DataFrame, keys: Sequence[str] = ("request_id", "pos", "stc")) -> DataFrame:
    """One row per benefit line of each good tile, amounts and percents as decimals."""
    good = tiles.where(F.col("ok")).select(
        *keys, F.try_variant_get("response", "$.benefitsInformation", "variant").alias("_lines"))
    line = F.col("value")
    return (good.where(_kind(F.col("_lines")).startswith("ARRAY"))
            .lateralJoin(_explode("_lines").withColumnRenamed("pos", "line_no"))
            .select(*keys, F.col("line_no").cast("int").alias("line_no"), _text(line, "$.code").alias("code"),
                    _text(line, "$.benefitAmount").try_cast("decimal(12,2)").alias("amount"),
                    _text(line, "$.benefitPercent").try_cast("decimal(9,4)").alias("percent"),
                    _text(line, "$.timeQualifierCode").alias("period"),
                    _text(line, "$.coverageLevelCode").alias("level")))


def gate(requests: DataFrame, tiles: DataFrame, no_payer: Column | None = None) -> DataFrame:
    """Per request whether at least one tile is good, and otherwise the first error."""
    per_request = tiles.groupBy("request_id").agg(
        F.count_if("ok").alias("ok_tiles"),
        F.min(F.when(~F.col("ok"), F.struct("pos", "error"))).alias("_first"))
    fallback = F.lit("no tile came back")
    if no_payer is not None:
        fallback = F.when(no_payer, "none of the payer ids works").otherwise(fallback)
    ok = F.coalesce(F.col("ok_tiles"), F.lit(0))
    return (requests.join(per_request, "request_id", "left")
            .withColumn("ok_tiles", ok).withColumn("gate_open", F.col("ok_tiles") > 0)
            .withColumn("gate_error", F.when(~F.col("gate_open"), F.coalesce(F.col("_first.error"), fallback)))
            .drop("_first"))
