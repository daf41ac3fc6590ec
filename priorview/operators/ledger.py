"""Claim ledger star and the cost-share pivot, as states over time.

The pivot of a claim line depends on the as-of date only through which postings were already
there. So it is computed once for all requests, as a step function: one state per posting day,
valid until the next one. A request then looks up the states valid on its as-of date.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import last_asof_date
from ..sources import commits as cm
from .asof import asof_topn, distinct_asof
from .sliding import newest_only, visible_sums_at

LINE_KEY = ["procedurecode", "patientid", "claimappointmentid", "claimservicedate"]
CODE_KEY = ["procedurecode", "patientid", "claimid", "context_id", "claimappointmentid", "claimservicedate",
            "primary_memberid", "primary_package", "secondary_memberid", "secondary_package",
            "patientinsuranceid"]
AMOUNTS = ["deduct", "coins", "copay", "allowable", "payment", "other"]

# Ledger vocabulary.
DEDUCTIBLE_REASONS = ("DEDUCTIBLE", "DEDUCT")
COINSURANCE_REASON = "COINSURANCE"
COPAY_REASON = "COPAY"
TRANSFER_TYPES = ("TRANSFERIN", "TRANSFEROUT")
ALLOWABLE_TYPES = ("CHARGE", "ADJUSTMENT")
PAYMENT_TYPE = "PAYMENT"
CLOSED = "CLOSED"
NO_STATES = "-"  # of a month in a record

def forever() -> Column:
    return F.lit("9999-12-31").cast("date")


def claim_star(claim: DataFrame, patient: DataFrame, patientinsurance: DataFrame,
               insurancepackage: DataFrame, transaction: DataFrame, chargedetail: DataFrame,
               organization: DataFrame) -> DataFrame:
    """Closed, unvoided ledger at transaction grain, free of any request.

    Appointment tables feed no output and are left out; that needs their ids to be unique.
    An organisation row is expected once per org id. Context ids are compared as text, since
    some systems use GUIDs and others numbers.
    """
    insurance = patientinsurance.select(
        "contextid", "patientid", "patientinsuranceid", "insurancepackageid",
        "policyidnumber", "policygroupnumber")
    packages = insurancepackage.select("contextid", "insurancepackageid", "name")
    insured = insurance.join(packages, ["contextid", "insurancepackageid"], "left")

    def side(prefix: str, key: str, *extra: Column) -> DataFrame:
        return insured.select("contextid", "patientid", F.col("patientinsuranceid").alias(key),
                              F.col("policyidnumber").alias(f"{prefix}_memberid"),
                              F.col("name").alias(f"{prefix}_package"), *extra)

    primary = side("primary", "claimprimarypatientinsid", F.col("policygroupnumber").alias("group_number"),
                   F.col("patientinsuranceid"))
    secondary = side("secondary", "claimsecondarypatientinsid")
    charges = chargedetail.select("contextid", F.col("chargeid").alias("parentchargeid"), "procedurecode")
    orgs = organization.select("org_id", F.col("ehr_context_id").cast("string").alias("context_key"))

    closed = claim.where((F.col("primaryclaimstatus") == CLOSED) & (F.col("secondaryclaimstatus") == CLOSED))
    posted = (transaction.where(F.col("voideddate").isNull())
              .select("claimid", "contextid", "parentchargeid", "transactiontype", "transactiontransfertype",
                      "transactionreason", "amount",
                      F.col("transactioncreateddatetime").cast("date").alias("posted_on"))
              .join(charges, ["parentchargeid", "contextid"], "left"))
    return (closed.join(patient.select("patientid", "contextid"), ["patientid", "contextid"])
            .join(primary, ["contextid", "patientid", "claimprimarypatientinsid"], "left")
            .join(secondary, ["contextid", "patientid", "claimsecondarypatientinsid"], "left")
            .withColumn("context_key", F.col("contextid").cast("string"))
            .join(orgs, "context_key")
            .join(posted, ["claimid", "contextid"])
            .withColumnRenamed("contextid", "context_id")
            .select("org_id", "group_number", *CODE_KEY, "transactiontype", "transactiontransfertype",
                    "transactionreason", "amount", "posted_on"))


def amount_rules() -> dict[str, tuple[Column, Column]]:
    """Name -> (which postings count, signed amount). A NULL reason is neither in nor out of
    the reason list of ``other``, so it counts nowhere."""
    kind, to, why = (F.col("transactiontype"), F.col("transactiontransfertype"), F.col("transactionreason"))
    amount = F.col("amount")
    patient_transfer = (to == "Patient") & kind.isin(*TRANSFER_TYPES)
    known = (COPAY_REASON, COINSURANCE_REASON, *DEDUCTIBLE_REASONS)
    return {
        "deduct": (patient_transfer & why.isin(*DEDUCTIBLE_REASONS), amount),
        "coins": (patient_transfer & (why == COINSURANCE_REASON), amount),
        "copay": (patient_transfer & (why == COPAY_REASON), amount),
        "allowable": ((to == "Primary") & kind.isin(*ALLOWABLE_TYPES), amount),
        "payment": (to.isin("Primary", "Secondary") & (kind == PAYMENT_TYPE), -amount),
        "other": (patient_transfer & ~why.isin(*known), amount),
    }


def cost_share_pivot(transactions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One-pass pivot: six conditional sums in one aggregate. A sum over no posting is NULL."""
    return transactions.groupBy(*keys).agg(
        *[F.sum(F.when(cond, value)).alias(name) for name, (cond, value) in amount_rules().items()])


def _unique(*cols: str) -> list[str]:
    return list(dict.fromkeys(cols))


def _line_key(scope: Sequence[str], totals_per_claim: bool = False) -> list[str]:
    return _unique(*scope, *LINE_KEY, *(["claimid"] if totals_per_claim else []))


def _rank_key(scope: Sequence[str], rank_per_claim: bool = False) -> list[str]:
    return _unique(*scope, "patientinsuranceid", "claimservicedate", "procedurecode",
                   *(["patientid", "claimid"] if rank_per_claim else []))


def _all_known(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def _scoped(star: DataFrame, scope: Sequence[str]) -> DataFrame:
    return star.where(_all_known([*scope, "posted_on"]))


def daily_postings(star: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Postings of one line and day in one row: sums, how many postings each has, and how many
    there are. Such rows add up, so those of several batches may stand side by side."""
    scoped = _scoped(star, scope)
    parts = [F.count(F.lit(1)).alias("n_postings")]
    for name, (cond, value) in amount_rules().items():
        parts += [F.sum(F.when(cond, value)).alias(name), F.count(F.when(cond, value)).alias(f"n_{name}")]
    return scoped.groupBy(*_unique(*scope, *CODE_KEY, "posted_on")).agg(*parts)


def without(daily: DataFrame) -> DataFrame:
    """Daily rows that take postings back, as when they are voided after they were counted."""
    signed = [c for name in AMOUNTS for c in (name, f"n_{name}")]
    return daily.withColumns({c: (-F.col(c)).cast(daily.schema[c].dataType) for c in ["n_postings", *signed]})


def line_states(star: DataFrame, scope: Sequence[str], lookback_months: int = 24,
                totals_per_claim: bool = False, rank_per_claim: bool = False) -> DataFrame:
    """Claim-line states with the interval of as-of dates in which each one is the answer.

    ``totals_per_claim=False`` shares totals between claims with equal line keys;
    ``rank_per_claim=False`` keeps one line per (insurance, date, code) of the scope. Both are
    the source's behaviour. The line is chosen before the ``allowable > 0 and other is NULL``
    filter, and lines whose keys are NULL still take part in that choice.
    """
    paid = [F.when(cond, value).alias(name) for name, (cond, value) in amount_rules().items()]
    rows = _scoped(star, scope).select(*_line(scope), "posted_on", *paid)
    return _visible_states(_in_cells(rows, scope), scope, _line_key(scope, totals_per_claim), lookback_months, rank_per_claim)


def states_of(daily: DataFrame, scope: Sequence[str], lookback_months: int = 24,
              totals_per_claim: bool = False, rank_per_claim: bool = False) -> DataFrame:
    """``line_states`` from daily rows; everything here works on this reduced table."""
    sums = ["n_postings", *[c for name in AMOUNTS for c in (name, f"n_{name}")]]
    days = _in_cells(daily, scope).groupBy(*_line(scope), "posted_on").agg(*[F.sum(c).alias(c) for c in sums])
    return _visible_states(days, scope, _line_key(scope, totals_per_claim), lookback_months, rank_per_claim)


def _line(scope: Sequence[str]) -> list[str]:
    return _unique(*scope, *CODE_KEY)


def _cell(scope: Sequence[str]) -> list[str]:
    """What line keys and rank keys both hold, so no group of either reaches over a cell's border."""
    return _unique(*scope, "claimservicedate", "procedurecode")


def _in_cells(rows: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Rows dealt out by cell. Lines, line keys and rank keys are then whole where they are, so all that
    follows is one flow: the rows are read, joined and sent once."""
    return rows.repartition(*_cell(scope))


def _visible_states(rows: DataFrame, scope: Sequence[str], by_line: Sequence[str], lookback_months: int, rank_per_claim: bool) -> DataFrame:
    """States from amounts by claim line and day (rows in cells). With counts of postings there is one
    row for a line and day, and days and amounts without any left do not count."""
    counted = "n_postings" in rows.columns
    there = F.col("n_postings") > 0 if counted else F.lit(True)
    counts = ["n_postings", *[f"n_{name}" for name in AMOUNTS]] if counted else []
    lines = rows.groupBy(*_line(scope)).agg(F.date_add(F.min(F.when(there, F.col("posted_on"))), 1).alias("c_from"),
                                            F.collect_list(F.struct("posted_on", *AMOUNTS, *counts)).alias("_postings"))
    # Which line stands for its (insurance, date, code), and until when. Its first posting carries that.
    better = (Window.partitionBy(*_rank_key(scope, rank_per_claim)).orderBy(*code_order(), F.col("c_from").asc_nulls_last())
              .rowsBetween(Window.unboundedPreceding, -1))
    chosen = F.when(F.col("c_from") < F.col("c_to"), F.struct(*[c for c in _line(scope) if c not in by_line], "c_from", "c_to"))
    ranked = (lines.withColumn("c_to", F.coalesce(F.min("c_from").over(better), forever())).where(_all_known(by_line))
              .select(*by_line, chosen.alias("_own"), F.posexplode("_postings").alias("_at", "_p"))
              .select(*by_line, "_p.*", F.when(F.col("_at") == 0, F.col("_own")).alias("_chosen")))

    # Running totals per line key, one version per posting day.
    whole = Window.partitionBy(*by_line)
    in_order = whole.orderBy("posted_on")
    so_far = in_order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranked.withColumn("_lines", F.collect_list("_chosen").over(whole)).where(F.size("_lines") > 0)
    if counted:
        ranked = ranked.withColumn("_left", F.sum("n_postings").over(in_order.rangeBetween(Window.currentRow, Window.currentRow))).where("_left > 0")
    total = lambda name: F.sum(name).over(so_far)
    running = {name: F.when(total(f"n_{name}") > 0, total(name)) if counted else total(name) for name in AMOUNTS}
    versions = (ranked.withColumns({**running, "_next": F.lead("posted_on").over(in_order)})
                .where(F.col("_next").isNull() | (F.col("_next") > F.col("posted_on")))
                .where((F.col("allowable") > 0) & F.col("other").isNull())
                .select(*by_line, F.inline("_lines"), *AMOUNTS, F.date_add("posted_on", 1).alias("v_from"),
                        F.coalesce(F.date_add("_next", 1), forever()).alias("v_to")))
    first_day = F.date_add("claimservicedate", 1)
    end_day = F.date_add(last_asof_date("claimservicedate", lookback_months), 1)
    return (versions.withColumn("valid_from", F.greatest("c_from", "v_from", first_day))
            .withColumn("valid_to", F.least("c_to", "v_to", end_day))
            .where(F.col("valid_from") < F.col("valid_to"))
            .drop("c_from", "c_to", "v_from", "v_to"))


def code_order() -> list[Column]:
    """Order among the lines of one rank key, lowest claim id first. It is total as a claim id
    is unique within an organisation's context and a claim has one insurance pair."""
    return [F.col("claimid").asc_nulls_last(), F.col("patientid").asc_nulls_last()]


def build_line_states(star: DataFrame, scope: Sequence[str], path: str, lookback_months: int = 24, **options) -> None:
    """Write the states of a whole ledger, partitioned by service month, for many later look-ups
    with ``ledger_lookup``. `apply_postings` keeps such a table up to date instead."""
    states = line_states(star, scope, lookback_months, **options)
    months = states.withColumn("service_month", F.trunc("claimservicedate", "month"))
    months.repartition("service_month", F.pmod(F.xxhash64(*scope), F.lit(64))).write.partitionBy("service_month").parquet(path)


def apply_postings(star: DataFrame, path: str, scope: Sequence[str], batch: str, voided: DataFrame | None = None,
                   lookback_months: int = 24, totals_per_claim: bool = False, rank_per_claim: bool = False) -> bool:
    """Bring a stored ledger up to date with a batch of postings (rows of ``claim_star``), and take
    ``voided`` ones back. The first batch founds it. False if the batch is in already.

    The batch's daily rows are appended. States change only where a line key or a rank key has
    postings of the batch; both hold the service date, so only its service months are read and
    written anew, and in them only the cells (scope, service date, code) that the batch touches
    are worked out again, as a whole; other rows are carried over. Cells go by their hashes; two
    of one hash are only worked out together. One record makes both tables visible at once, so a
    job that fails in between changes nothing. Scopes of a month are spread over its files by hash.
    """
    spark, scope = star.sparkSession, list(scope)
    daily = daily_postings(star, scope)
    if voided is not None:
        daily = daily.unionByName(without(daily_postings(voided, scope)))
    daily = daily.where(F.col("claimservicedate").isNotNull()).withColumn("service_month", F.trunc("claimservicedate", "month"))
    records = cm.live(cm.commits(spark, path))
    cell = F.xxhash64(*_cell(scope))

    def write() -> tuple[list[str], str]:
        folder = cm.part(path, batch, "daily")
        daily.hint("rebalance", "service_month").write.mode("overwrite").partitionBy("service_month").parquet(folder)
        own = cm.read(spark, path, daily.schema, [folder], "daily")
        # One value for each month of the calendar that the batch has.
        months = sorted(r[0] for r in own.select("service_month").distinct().collect())
        every = [*(cm.part(path, r["id"], "daily") for r in records), folder]
        known = cm.read(spark, path, daily.schema, every, "daily").where(F.col("service_month").isin(months))
        cells = own.select(cell.alias("_cell")).distinct()
        of_cells = lambda rows, how: rows.withColumn("_cell", cell).join(cells, "_cell", how).drop("_cell")
        groups = of_cells(known, "left_semi") if records else own
        fresh = states_of(groups.drop("service_month"), scope, lookback_months, totals_per_claim, rank_per_claim)
        both = fresh.withColumn("service_month", F.trunc("claimservicedate", "month"))
        older = _state_folders(path, records, months)
        if older:
            both = both.unionByName(of_cells(cm.read(spark, path, both.schema, older, "states"), "left_anti"))
        states = cm.part(path, batch, "states")
        both.repartition("service_month", F.pmod(F.xxhash64(*scope), F.lit(64))).write.mode("overwrite").partitionBy("service_month").parquet(states)
        held = {r[0] for r in cm.read(spark, path, both.schema, [states], "states").select("service_month").distinct().collect()}
        return [f"{m}" if m in held else f"{m} {NO_STATES}" for m in months], both.schema.json()

    return cm.commit(spark, path, batch, write)


def _state_folders(path: str, records: list[dict], months: Sequence | None = None) -> list[str]:
    """The folder of the newest states of each month that has any."""
    newest = {}
    for r in records:
        for key in r["keys"]:
            month, _, none = key.partition(" ")
            newest[month] = None if none else r["id"]
    wanted = newest if months is None else map(str, months)
    return [f"{cm.part(path, newest[m], 'states')}/service_month={m}" for m in sorted(wanted) if newest.get(m)]


def kept_states(spark: SparkSession, path: str) -> DataFrame:
    """The states of a ledger that `apply_postings` keeps, for ``ledger_lookup``."""
    records = cm.live(cm.commits(spark, path))
    if not records:
        raise ValueError(f"no ledger in {path}")
    return cm.read(spark, path, StructType.fromJson(json.loads(records[-1]["note"])), _state_folders(path, records), "states")


def asked_part(rows: DataFrame, probes: DataFrame, scope: Sequence[str], asof: str, lookback_months: int = 24) -> DataFrame:
    """The ledger rows that some probe can see: of its scopes, and of service dates from the
    first probe's lookback up to the last probe. Both are part of the plan and start no job."""
    bounds = probes.agg(F.add_months(F.min(asof), -lookback_months).alias("first"), F.max(asof).alias("last"))
    day = F.col("claimservicedate")
    return (rows.where((day >= bounds.select("first").scalar()) & (day < bounds.select("last").scalar()))
            .join(probes.select(*scope).distinct(), list(scope), "left_semi"))


def line_order() -> list[Column]:
    """Order among the states of one service date."""
    return [F.col("procedurecode").asc_nulls_last(), *code_order()]


def newest_lines(requests: DataFrame, states: DataFrame, scope: Sequence[str], asof: str, n: int | None = None) -> DataFrame:
    """States whose intervals show each (scope, as-of) its newest ``n`` claim lines only."""
    if n is None:
        return states
    return newest_only(distinct_asof(requests, scope, asof), states, scope, asof, "claimservicedate", line_order(), n)


def ledger_lookup(requests: DataFrame, states: DataFrame, scope: Sequence[str], asof: str, n: int | None = None,
                  lookback_months: int = 24, tier_months: int = 3) -> DataFrame:
    """``ledger_history`` from stored states, of which only the asked scopes and months are read."""
    probes = distinct_asof(requests, scope, asof)
    if "service_month" in states.columns:
        bounds = probes.agg(F.trunc(F.add_months(F.min(asof), -lookback_months), "month").alias("first"), F.max(asof).alias("last"))
        month = F.col("service_month")
        states = states.where((month >= bounds.select("first").scalar()) & (month <= bounds.select("last").scalar())).drop("service_month")
    return asked_lines(probes, asked_part(states, probes, scope, asof, lookback_months), scope, asof, n, lookback_months, tier_months)


def asked_lines(probes: DataFrame, states: DataFrame, scope: Sequence[str], asof: str, n: int | None = None,
                lookback_months: int = 24, tier_months: int = 3) -> DataFrame:
    """``ledger_lookup`` of distinct (scope, as-of) in states that hold no more than what these can see."""
    return asof_topn(probes, states, scope, asof, "claimservicedate", line_order(), n, lookback_months, tier_months)


def dense_lines(probes: DataFrame, states: DataFrame, scope: Sequence[str], asof: str, n: int, ranked: bool = True,
                keep: Callable[[DataFrame], DataFrame] = lambda cut: cut) -> DataFrame:
    """``asked_lines`` for scopes with many more lines than ``n`` in a month, from stored states: their intervals
    are cut first, so no other pairs than the newest ``n`` of each (scope, as-of) are made. ``keep`` stores the cut
    states, which are read twice. Without ``ranked`` the count of all visible lines is left out."""
    scope = list(scope)
    cut = keep(newest_only(probes, states, scope, asof, "claimservicedate", line_order(), n))
    found = asked_lines(probes, cut, scope, asof, n, tier_months=1).drop("total_rows")
    if not ranked:
        return found
    totals = visible_sums_at(probes.select(*scope, asof), states, scope, asof, {"total_rows": F.lit(1)})
    return found.join(totals, [*scope, asof])


def ledger_history(requests: DataFrame, star: DataFrame, scope: Sequence[str], asof: str, n: int | None = None,
                   lookback_months: int = 24, tier_months: int = 3, **options) -> DataFrame:
    """Per (scope, as-of) the newest ``n`` claim lines (all without ``n``) with their cost-share
    amounts, and ``total_rows``. A probe stands once in each tier of months that it can see: scopes
    of few lines do with wide tiers. Join it to the requests on (scope, as-of). Only the part of the
    ledger that the requests can see is worked on, and nothing runs before the result is asked for."""
    probes = distinct_asof(requests, scope, asof)
    part = asked_part(star, probes, scope, asof, lookback_months)
    return asked_lines(probes, line_states(part, scope, lookback_months, **options), scope, asof, n, lookback_months, tier_months)
