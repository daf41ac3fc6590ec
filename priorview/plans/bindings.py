"""Domain tables derived from the test tables, for the registered queries.

The mapping carries no meaning of its own; it only gives each operator columns of the right
kind, including the awkward values (duplicates, NULLs, zero amounts) the operator must handle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import computed_once

# Powers of two, so that the weights 1/p are exact.
PRIORITY_P = {"1-URGENT": 1.0, "2-HIGH": 0.5, "3-MEDIUM": 0.25, "4-NOT SPECIFIED": 0.125, "5-LOW": 0.0625}


class Tables:
    """The parquet tables of one folder, each opened once, on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        setattr(self, name, table)
        return table


def money(col: str) -> Column:
    return F.col(col).cast("decimal(12,2)")


def day(col: str) -> Column:
    return F.col(col).cast("date")


def _priority_p() -> Column:
    p = F.lit(None).cast("double")
    for name, value in PRIORITY_P.items():
        p = F.when(F.col("o_orderpriority") == name, value).otherwise(p)
    return p


def results(t: Tables) -> DataFrame:
    """Stored result rows: one per order line, estimate from price and discount."""
    confidence = (F.when(F.col("l_quantity") >= 35, "HIGH").when(F.col("l_quantity") >= 15, "MEDIUM")
                  .when(F.col("l_quantity") >= 2, "LOW").otherwise("UNABLE_TO_PRICE"))
    unable = F.col("l_quantity") < 2
    estimate = F.round(money("l_extendedprice") * F.col("l_discount").cast("decimal(4,2)"), 2).cast("decimal(12,2)")
    orders = t.orders.select("o_orderkey", "o_orderpriority", "o_orderdate", "o_custkey")
    return (t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("l_orderkey").cast("string").alias("request_id"),
                    (F.col("l_suppkey") % 3).alias("hrt_id"),
                    F.col("l_partkey").alias("srt_id"),
                    F.when(~unable, estimate).alias("estimated_patient_resp"),
                    confidence.alias("confidence"),
                    F.when(F.col("l_quantity") == 50, "ERROR").otherwise("COMPLETED").alias("status"),
                    F.concat(F.lit("build-"), F.col("l_linestatus")).alias("pricer_version"),
                    F.concat(F.lit("tier-"), F.col("l_returnflag")).alias("model_id"),
                    F.lit("floor").alias("sampling_reason"),
                    F.concat(F.lit("prio:"), F.col("o_orderpriority")).alias("sampling_stratum"),
                    _priority_p().alias("inclusion_probability"),
                    day("o_orderdate").alias("pricing_date"),
                    F.col("o_custkey").alias("member_id")))


def priced_treatments(t: Tables) -> DataFrame:
    """Incumbent prices with re-pricing duplicates; some have no creation time."""
    hrt = F.col("l_suppkey") % 3
    return t.lineitem.select(
        (F.col("l_orderkey") * 10 + hrt).alias("priced_treatment_id"),
        F.col("l_orderkey").cast("string").alias("request_id"), hrt.alias("hrt_id"),
        F.round(money("l_extendedprice") * F.lit("0.04").cast("decimal(3,2)"), 2).cast("decimal(12,2)").alias("price"),
        F.when(F.col("l_quantity") != 7, F.col("l_shipdate")).alias("created_at"))


def bought_treatments(t: Tables) -> DataFrame:
    ids = t.orders.select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("h"))
    key = F.col("o_orderkey") * 10 + F.col("h")
    return ids.select(key.alias("priced_treatment_id"), key.alias("slot_id"))


def slots(t: Tables) -> DataFrame:
    return bought_treatments(t).select("slot_id", F.floor(F.col("slot_id") / 10).alias("ehr_slot_id"))


def ehr_slots(t: Tables) -> DataFrame:
    return (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .select(F.col("o_orderkey").alias("ehr_slot_id"),
                    F.col("o_orderkey").cast("string").alias("ehr_visit_id"),
                    F.col("c_nationkey").cast("string").alias("org_id")))


def outcome_claims(t: Tables) -> DataFrame:
    """Adjudicated claims, several per visit, some of them not settled, some zero."""
    status = (F.when(F.col("l_returnflag") == "R", "TRANSFERRED")
              .when(F.col("l_returnflag") == "A", "ADJUSTED").otherwise("MANUAL_REVIEW"))
    who = (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
           .select("o_orderkey", "c_nationkey"))
    return (t.lineitem.join(who, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("l_orderkey").alias("visit_id"), F.col("c_nationkey").cast("long").alias("org_id"),
                    (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("claim_id"),
                    status.alias("art_claim_status"),
                    F.when(F.col("l_quantity") != 13,
                           F.round(money("l_extendedprice") * F.col("l_tax").cast("decimal(4,2)"), 2)
                           .cast("decimal(12,2)")).alias("total_adjudicated_responsibility"),
                    F.col("l_shipdate").alias("created_at")))


def scored_chain(t: Tables) -> DataFrame:
    from ..operators import scorecard as s

    return s.outcome_chain(s.rollup_estimates(results(t)), s.latest_prices(priced_treatments(t)),
                           bought_treatments(t), slots(t), ehr_slots(t),
                           s.latest_outcomes(outcome_claims(t)))


def requests(t: Tables) -> DataFrame:
    """Pricing requests: one per order."""
    return (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("member_id"),
                    F.col("c_nationkey").alias("org_id"), F.col("o_custkey").alias("patientid"),
                    F.col("c_mktsegment").alias("group_number"), day("o_orderdate").alias("asof")))


def canonical_claims(t: Tables) -> DataFrame:
    """Settled claims by member; orders still in progress have no responsibility."""
    return (t.orders.where(F.col("o_orderstatus") != "P")
            .select(F.col("o_custkey").alias("member_id"), day("o_orderdate").alias("date_of_service"),
                    F.col("o_orderkey").alias("claim_ref"), money("o_totalprice").alias("pnr")))


def _context(nation: str) -> Column:
    return F.concat(F.lit("ctx-"), F.col(nation))


def _lines_with_customer(t: Tables) -> DataFrame:
    """Few columns of a large compressed file look small enough to send through the driver, and are not; hence the hint."""
    who = (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
           .select("o_orderkey", "o_custkey", "c_nationkey"))
    return t.lineitem.hint("merge").join(who, F.col("l_orderkey") == F.col("o_orderkey"))


def ledger_star(t: Tables) -> DataFrame:
    from ..operators.ledger import claim_star

    key = F.col("o_orderkey")
    claim = (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
             .select(key.alias("claimid"), _context("c_nationkey").alias("contextid"),
                     F.col("o_custkey").alias("patientid"),
                     F.when(key % 7 != 0, F.col("o_custkey") % 3).alias("claimappointmentid"),
                     F.trunc("o_orderdate", "month").alias("claimservicedate"),
                     F.when(key % 11 != 0, F.col("o_custkey") * 10 + key % 2).alias("claimprimarypatientinsid"),
                     F.when(key % 3 == 0, F.col("o_custkey") * 10 + 1 - key % 2).alias("claimsecondarypatientinsid"),
                     F.lit("CLOSED").alias("primaryclaimstatus"),
                     F.when((F.col("o_orderstatus") != "P") | (key % 2 == 1), "CLOSED").alias("secondaryclaimstatus")))
    patient = t.customer.select(F.col("c_custkey").alias("patientid"), _context("c_nationkey").alias("contextid"))
    insurance = (t.customer.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
                 .select((F.col("c_custkey") * 10 + F.col("i")).alias("patientinsuranceid"),
                         _context("c_nationkey").alias("contextid"), F.col("c_custkey").alias("patientid"),
                         ((F.col("c_custkey") + F.col("i")) % 4).alias("insurancepackageid"),
                         F.concat(F.lit("M"), F.col("c_custkey"), F.lit("-"), F.col("i")).alias("policyidnumber"),
                         F.when(F.col("c_custkey") % 13 != 0, F.col("c_mktsegment")).alias("policygroupnumber")))
    package = (insurance.select("insurancepackageid", "contextid").distinct()
               .withColumn("name", F.concat(F.lit("plan "), F.col("insurancepackageid"))))
    slot = F.col("l_suppkey") % 10
    reason = (F.when(slot == 7, F.when(F.col("l_linenumber") % 2 == 0, "DEDUCTIBLE").otherwise("DEDUCT"))
              .when(slot == 8, F.when(F.col("l_linenumber") % 2 == 0, "COINSURANCE").otherwise("COPAY"))
              .when((slot == 9) & (F.col("l_linenumber") % 3 == 1), "COPAY")
              .when((slot == 9) & (F.col("l_linenumber") % 3 == 2), "NONCOVERED"))
    sign = F.when(slot.isin(4, 5, 6), -1).otherwise(1)
    transaction = _lines_with_customer(t).select(
        F.col("l_orderkey").alias("claimid"), _context("c_nationkey").alias("contextid"),
        F.col("l_partkey").alias("parentchargeid"),
        F.when(slot <= 3, "CHARGE").when(slot == 4, "ADJUSTMENT").when(slot <= 6, "PAYMENT")
        .when(slot <= 8, "TRANSFERIN").otherwise("TRANSFEROUT").alias("transactiontype"),
        F.when(slot <= 5, "Primary").when(slot == 6, "Secondary").otherwise("Patient").alias("transactiontransfertype"),
        reason.alias("transactionreason"),
        F.when(F.col("l_quantity") != 11, money("l_extendedprice") * sign).cast("decimal(12,2)").alias("amount"),
        F.col("l_shipdate").alias("transactioncreateddatetime"),
        F.when(F.col("l_quantity") == 3, F.col("l_shipdate")).alias("voideddate"))
    charge = (_lines_with_customer(t).select(F.col("l_partkey").alias("chargeid"), _context("c_nationkey").alias("contextid"))
              .distinct()
              .withColumn("procedurecode", F.when(F.col("chargeid") % 17 != 0,
                                                  F.concat(F.lit("P"), F.col("chargeid") % 5))))
    organization = t.nation.select(F.col("n_nationkey").alias("org_id"), _context("n_nationkey").alias("ehr_context_id"))
    return claim_star(claim, patient, insurance, package, transaction, charge, organization)


def eligibility_tracks(t: Tables) -> DataFrame:
    """Signup events as eligibility tracks, created up to five days after their service day."""
    k = F.get_json_object("props", "$.k").cast("int")
    ts = F.col("ts")
    return (t.events.where(F.col("event_type") == "signup")
            .select(F.lit("c1").alias("contextid"), F.col("user_id").alias("patientinsuranceid"),
                    F.col("event_id").alias("eligibilitytrackid"),
                    F.date_format(ts, "yyyy-MM-dd'T'HH:mm").alias("dateofservicedatetime"),
                    (ts + F.make_dt_interval(k % 6)).alias("createddatetime"),
                    F.when(k % 9 == 0, "<b class=errortext>failed").otherwise("<b class=successtext>ok").alias("verificationnote"),
                    F.when(k % 8 != 0, F.col("props")).alias("incomingtransaction")))


def ledger_tracks(t: Tables) -> DataFrame:
    """Events of a customer as eligibility tracks of the customer's insurances in the ledger."""
    k = F.col("event_id")
    serves = F.date_add(F.lit("1993-01-01").cast("date"), (k * 37 % 2000).cast("int"))
    return (t.events.join(t.customer, F.col("user_id") == F.col("c_custkey"))
            .select(_context("c_nationkey").alias("contextid"), (F.col("user_id") * 10 + k % 2).alias("patientinsuranceid"),
                    k.alias("eligibilitytrackid"), serves.cast("string").alias("dateofservicedatetime"),
                    F.date_add(serves, (k % 50).cast("int")).cast("timestamp").alias("createddatetime"),
                    F.when(k % 9 == 0, "<b class=errortext>failed").otherwise("<b class=successtext>ok").alias("verificationnote"),
                    F.when(k % 8 != 0, F.concat(F.lit("271-"), k)).alias("incomingtransaction")))


def ledger_benefits(t: Tables) -> DataFrame:
    return eligibility_benefits(t).drop("contextid").join(ledger_tracks(t).select("eligibilitytrackid", "contextid"), "eligibilitytrackid")


def event_lines(t: Tables) -> DataFrame:
    """Purchase events as claim lines; the request that looks back comes two days later."""
    k = F.get_json_object("props", "$.k").cast("int")
    return (t.events.where(F.col("event_type") == "purchase")
            .select(F.col("event_id").alias("claimid"), F.lit("c1").alias("contextid"),
                    F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("patientinsuranceid"),
                    day("ts").alias("claimservicedate"), (k % 4).alias("procedurecode"),
                    F.date_add(day("ts"), 2).alias("asof")))


def eligibility_benefits(t: Tables) -> DataFrame:
    """Order lines as benefit rows of one track per order."""
    line = F.col("l_linenumber")
    return t.lineitem.select(
        F.col("l_orderkey").alias("eligibilitytrackid"), F.lit("c1").alias("contextid"),
        F.when(F.col("l_returnflag") == "R", "C").when(F.col("l_returnflag") == "A", "G").otherwise("B").alias("benefitinfo"),
        F.when(F.col("l_linestatus") == "O", "IND").otherwise("FAM").alias("coveragelevel"),
        F.element_at(F.array(*[F.lit(p) for p in ("25", "23", "22", "29", "24", "27", "29")]), line).alias("timeperiodtype"),
        F.when(F.col("l_quantity") < 5, "98").otherwise("30").alias("servicetypecode"),
        F.when(F.col("l_suppkey") % 7 == 0, "N").when(F.col("l_suppkey") % 7 != 1, "Y").alias("plannetwork"),
        F.when(F.col("l_quantity") == 20, "abc").when(F.col("l_quantity") == 21, "")
        .otherwise(money("l_extendedprice").cast("string")).alias("monetaryamount"),
        F.when(F.col("l_quantity") > 40, F.concat(F.lit("plan "), F.col("l_partkey"))).alias("plancoveragedesc"))


# Payer texts of the service-type requests; every rule of the override table can be reached.
PAYER_TEXTS = ("Aetna PPO", "BCBS of NJ", "Cigna", "UHC Choice", "Medicaid NJ", "Oxford Health",
               "CareFirst BlueCross", "United", "GHI", "Blue Cross Cigna", "NJ Plan", "New Jersey Medicaid")
STATES = ("bolt", "ri", "RED", "")


def payers(t: Tables) -> DataFrame:
    """Parts as payers: many rows per name, code lists with blanks, repeats and leading zeros."""
    size = F.lpad(F.col("p_size").cast("string"), 3, "0")
    codes = F.concat(size, F.lit(", "), F.lpad((F.col("p_partkey") % 7).cast("string"), 2, "0"), F.lit(",, "), size)
    return t.part.select(F.when(F.col("p_size") != 9, codes).alias("availity_payer_code"),
                         F.col("p_name").alias("payer_name"))


def payer_requests(t: Tables) -> DataFrame:
    words = F.split("p_name", " ")
    kind = F.col("o_orderkey") % 4
    text = (F.when(kind == 0, words[0]).when(kind == 1, F.upper(words[1])).when(kind == 2, F.col("p_type"))
            .otherwise(F.concat(F.substring("p_name", 1, 2), F.lit("%"))))
    state = F.element_at(F.array(*[F.lit(s) for s in STATES]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return (t.orders.join(t.part, F.col("o_custkey") == F.col("p_partkey"))
            .select(F.col("o_orderkey").alias("request_id"), text.alias("payer"),
                    F.when(F.col("o_orderkey") % 5 < 4, state).alias("state")))


def default_providers(t: Tables) -> DataFrame:
    key = F.col("s_suppkey")
    npi = (F.when(key % 7 == 0, F.lit(None).cast("string")).when(key % 5 == 0, F.concat(F.lit("TEST"), key))
           .otherwise(F.concat(F.lit("1"), F.lpad(key.cast("string"), 9, "0"))))
    state = F.when(key % 3 == 0, "NY").when(key % 3 == 1, "nj")
    return t.supplier.select(F.col("s_nationkey").alias("org_id"), npi.alias("npi"), state.alias("state"))


def providers(t: Tables) -> DataFrame:
    """Two rows for some NPIs, no names for others."""
    key = F.col("s_suppkey")
    twice = t.supplier.withColumn("i", F.explode(F.when(key % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return twice.select(F.concat(F.lit("1"), F.lpad(key.cast("string"), 9, "0")).alias("npi"),
                        F.when(key % 6 != 0, F.concat(F.lit("F"), F.col("i"))).alias("first_name"),
                        F.concat(F.lit("L"), key % 11, F.lit("-"), F.col("i")).alias("last_name"))


def provider_requests(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    known = F.concat(F.lit(" 1"), F.lpad((F.col("o_custkey") % 100).cast("string"), 9, "0"), F.lit(" "))
    npi = F.when(key % 4 == 0, known).when(key % 4 == 1, "12345ABC90").when(key % 4 == 2, "123456789")
    return (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .select(key.alias("request_id"), F.col("c_nationkey").alias("org_id"), npi.alias("npi"),
                    F.when(key % 3 == 0, "Ann").when(key % 3 == 1, "").alias("provider_first_name"),
                    F.when(key % 5 == 0, "Request").alias("provider_last_name"),
                    F.when(key % 6 == 0, "ny").when(key % 6 == 1, "NJ").when(key % 6 == 2, "").when(key % 6 == 3, "TX").alias("state")))


def request_lines(t: Tables) -> DataFrame:
    """Order lines as request lines, spread over the organisations and ids the rules name."""
    lines = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    name = F.when(F.col("l_linenumber") == 7, "Weight Management visit").when(F.col("l_linenumber") == 6, "OBSTETRICS - new patient")
    payer = F.element_at(F.array(*[F.lit(p) for p in PAYER_TEXTS]), (F.col("o_custkey") % 12 + 1).cast("int"))
    return lines.select(F.col("l_orderkey").alias("request_id"),
                        (F.col("c_nationkey") + (F.col("l_orderkey") % 2) * 20).alias("org_id"), payer.alias("payer"),
                        (F.col("l_partkey") % 90 + 935).alias("hrt_id"), name.alias("hrt_name"),
                        F.col("l_partkey").alias("srt_id"), F.col("l_linenumber").alias("line_no"))


def srt(t: Tables) -> DataFrame:
    """Parts as priced lines; every 29th part is missing from the table."""
    size = F.col("p_size")
    primary = F.when(size % 5 == 1, "2").when(size % 5 == 2, "98").when(size % 5 == 3, "MH").when(size % 5 == 4, "5")
    secondary = F.when(size % 4 == 0, " 96, ,98 ").when(size % 4 == 1, "UC").when(size % 4 == 2, "")
    return (t.part.where(F.col("p_partkey") % 29 != 0)
            .select(F.col("p_partkey").alias("srt_id"), F.col("p_name").alias("srt_name"),
                    F.col("p_type").alias("srt_description"),
                    F.when(size % 6 == 0, "22").otherwise("11").alias("pos_code"), (size > 25).alias("is_specialist"),
                    primary.alias("primary_service_type"), secondary.alias("secondary_service_type"),
                    F.lit(None).cast("string").alias("tertiary_service_type")))


def srt_codes(t: Tables) -> DataFrame:
    """The nations that supply a part are its billing codes."""
    return (t.lineitem.select("l_partkey", "l_suppkey").distinct()
            .join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
            .select(F.col("l_partkey").alias("srt_id"), billing_code_text("s_nationkey").alias("billing_code")).distinct())


def billing_code_text(nation: str) -> Column:
    return F.concat(F.lit("992"), F.lpad(F.col(nation).cast("string"), 2, "0"))


def billing_codes(t: Tables) -> DataFrame:
    key = F.col("n_nationkey")
    return (t.nation.where(key != 3).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(billing_code_text("n_nationkey").alias("billing_code"),
                    F.when(key % 8 == 0, "Surgery").otherwise(F.col("r_name")).alias("code_group"),
                    F.col("n_name").alias("category"), F.concat(F.lit("code "), key).alias("description"),
                    (key * 1.5).cast("double").alias("rvu"), F.when(key % 12 == 1, 90).otherwise(0).alias("global_days")))


def _fill(template: str, **values: Column) -> Column:
    """A text with ``<name>`` places filled from columns; NULL fills in nothing."""
    import re

    parts = []
    for piece in re.split(r"(<\w+>)", template):
        if re.fullmatch(r"<\w+>", piece):
            parts.append(F.coalesce(values[piece[1:-1]].cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


# Request bodies: place 0 is whole, the others break one rule each, 10 and 11 are whole again.
_REQ = ('{"requestId":"r<k>","dto":{"firstName":"A","dateOfBirth":"1980-02-03","serviceDate":"<d>T10:00:00Z","extra":{"x":1},'
        '"primaryInsurance":{"memberId":"M<c>","payer":"Aetna PPO","state":"NY"},"orgId":10,'
        '"hrtToSrts":[{"hrtId":949,"srtIds":[<s>,7]}]}<sampling>}')
REQUEST_BODIES = (
    _REQ.replace("<sampling>", ',"sampling":{"stratum":"org:10","inclusionProbability":0.5,"requestType":"live"},"more":true'),
    _REQ.replace('"requestId":"r<k>",', "").replace("<sampling>", ""),
    _REQ.replace('"r<k>"', '""').replace("<sampling>", ""),
    _REQ.replace('"dateOfBirth":"1980-02-03",', "").replace("<sampling>", ""),
    _REQ.replace('"M<c>"', "<c>").replace("<sampling>", ""),
    _REQ.replace('[{"hrtId":949,"srtIds":[<s>,7]}]', "[]").replace("<sampling>", ""),
    _REQ.replace("[<s>,7]", "[]").replace("<sampling>", ""),
    _REQ.replace("<sampling>", ',"sampling":{"inclusionProbability":1.2}'),
    _REQ.replace('"orgId":10', '"orgId":"10"').replace("<sampling>", ""),
    '{"requestId":"r<k>","dto":{',
    _REQ.replace("<sampling>", ',"sampling":{"inclusionProbability":0}'),
    _REQ.replace("<d>T10", "on <d>T10").replace("<sampling>", ""),
)


def request_body(values: dict[str, Column]) -> Column:
    body = F.lit(None).cast("string")
    for i, template in enumerate(REQUEST_BODIES):
        body = F.when(values["k"] % 12 == i, _fill(template, **values)).otherwise(body)
    return body


def request_bodies(t: Tables) -> DataFrame:
    values = {"k": F.col("o_orderkey"), "d": day("o_orderdate"), "c": F.col("o_custkey"), "s": F.col("o_custkey") % 500}
    return (computed_once(t.orders, body=request_body(values))
            .select(F.col("o_orderkey").alias("source_key"), "body"))


def entities(t: Tables) -> DataFrame:
    """Stored entities with number-typed ids, missing dates and both coverage-spend fields."""
    k = F.col("o_orderkey")
    text = _fill('{"firstName":"B","dateOfBirth":"1990-01-01","ehrPatientId":<c>,<when>"orgId":"<n>",'
                 '"primaryInsurance":{"memberId":<c>,"payer":"Cigna","groupNumber":<k>},"npi":1234567890,'
                 '"hrtToSrts":[{"hrtId":"<h>","srtIds":["<s>",12]}],"coverageSpend":{"left":<k>}<over>}',
                 c=F.col("o_custkey"), n=k % 40, k=k, h=k % 5, s=k % 9,
                 when=F.when(k % 3 != 0, F.concat(F.lit('"serviceDate":"'), day("o_orderdate").cast("string"), F.lit('T08:00:00Z",'))),
                 over=F.when(k % 4 == 0, F.lit(',"coverageSpendOverride":{"left":5}')).when(k % 4 == 1, F.lit(',"coverageSpendOverride":null')))
    return computed_once(t.orders, requestinfo=F.parse_json(text)).select(k.cast("string").alias("id"), "requestinfo")


# Forwarded eligibility by event type: an array, a wrapped list, another vendor's shape,
# nothing, an empty list.
FORWARDED = {
    "view": '[{"stc":"30","response":{"benefitsInformation":[{"code":"C","benefitAmount":"<v>","timeQualifierCode":"29",'
            '"coverageLevelCode":"IND"},{"code":"A","benefitPercent":"0.2"},{"code":"G","benefitAmount":"n/a"}],'
            '"subscriber":{"groupNumber":"<g>"}}},{"stc":98,"response":{"benefitsInformation":[{"code":"B","benefitAmount":"<k>"}],'
            '"planInformation":{"groupNumber":"P<k>"}}},{"stc":"98","response":{"benefitsInformation":[]}}]',
    "click": '{"results":[{"stc":"30","response":{"benefitsInformation":[{"code":"C","benefitAmount":"<k>.5"}],'
             '"planInformation":{"groupNumber":"P<k>"}}},{"stc":"","response":{"benefitsInformation":[]}},{"stc":"7","response":null}]}',
    "purchase": '[{"stc":"30","response":{"coverage":"active"}}]',
    "signup": "[]",
}


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _value_text() -> Column:
    return F.col("value").cast("decimal(10,2)").cast("string")


def forwarded_requests(t: Tables) -> DataFrame:
    body = F.lit(None).cast("string")
    for kind, template in FORWARDED.items():
        group = F.when(_k() % 3 != 0, F.concat(F.lit("G"), _k()))
        text = _fill(template, v=_value_text(), k=_k(), g=group)
        body = F.when(F.col("event_type") == kind, text).otherwise(body)
    return (computed_once(t.events, eligibility=F.parse_json(body))
            .select(F.col("event_id").alias("request_id"),
                    F.when(_k() % 5 == 0, "REQ").when(_k() % 5 == 1, "").alias("group_number"), "eligibility"))


def own_responses(t: Tables) -> DataFrame:
    """Two own checks per event: HTTP error, payer rejection, broken text or a good answer."""
    pos = F.explode(F.array(F.lit(0), F.lit(1))).alias("pos")
    base = t.events.select("event_id", "value", "props", pos)
    place = (_k() + F.col("pos")) % 5
    good = _fill('{"benefitsInformation":[{"code":"B","benefitAmount":"<v>"}],"subscriber":{"groupNumber":"S<k>"}}',
                 v=_value_text(), k=_k())
    body = (F.when(place == 0, F.lit('{"message":"no provider"}')).when(place == 1, F.lit('{"errors":[{"code":"44"}]}'))
            .when(place == 2, F.lit("not json")).when(place == 3, F.lit('{"errors":[],"benefitsInformation":[]}')).otherwise(good))
    return (computed_once(base, body=body)
            .select(F.col("event_id").alias("request_id"), "pos", F.when(F.col("pos") == 0, "30").otherwise("98").alias("stc"),
                    F.when(place == 0, 400).otherwise(200).alias("http_status"), "body"))


def tiles(t: Tables) -> DataFrame:
    from ..operators.eligibility import choose_tiles, forwarded_tiles
    from ..sources.eligibility import classify_responses

    return choose_tiles(forwarded_tiles(forwarded_requests(t)), own_responses(t), classify=classify_responses)


def model_answers(t: Tables) -> DataFrame:
    """One stored answer per order under each of the answer keys, some of them broken, with
    both usage namings."""
    k = F.col("o_orderkey")
    key = F.when(k % 3 == 0, "object").when(k % 3 == 1, "structuredOutput").otherwise("experimental_output")
    price = ('{"hrtId":<h>,"srtId":<s>,"estimatedPatientResponsibility":<e>,"benefitType":"COPAY","confidence":"<conf>",'
             '"reasoning":"because",<breakdown>}')
    breakdown = ('"sourceBreakdown":{"stedi":"a","ownHistoricals":"b","groupHistoricals":"c","webSearch":"d","allowableSource":"e"}')
    amount = F.when(k % 5 == 0, "null").otherwise(money("o_totalprice").cast("string"))
    conf = F.when(k % 11 == 0, "SURE").when(k % 5 == 0, "UNABLE_TO_PRICE").when(k % 2 == 0, "HIGH").otherwise("LOW")
    parts = F.when(k % 13 == 0, F.lit('"x":1')).otherwise(F.lit(breakdown))
    one = lambda n: _fill(price, h=k % 7, s=k % 50 + n, e=amount, conf=conf, breakdown=parts)
    body = _fill('{"<key>":{"srtPrices":[<a>,<b>]<w>}}', key=key, a=one(0), b=one(1),
                 w=F.when(k % 4 == 0, F.lit(',"warnings":["w1","w2"]')))
    usage = _fill('{"<i>":<n>,"<o>":<m><c>}',
                  i=F.when(k % 2 == 0, "inputTokens").otherwise("promptTokens"), n=k * 7 % 100003,
                  o=F.when(k % 2 == 0, "outputTokens").otherwise("completionTokens"), m=k * 3 % 5003,
                  c=F.when(k % 6 == 0, F.concat(F.lit(',"cachedInputTokens":'), k % 4001))
                  .when(k % 6 == 1, F.concat(F.lit(',"cacheReadInputTokens":'), k % 4001)))
    return computed_once(t.orders, answer=F.parse_json(body), usage=F.parse_json(usage)).select(
        k.cast("string").alias("request_id"),
        F.when(k % 17 == 0, F.lit("soon")).otherwise(F.concat(day("o_orderdate").cast("string"), F.lit("T09:00:00Z"))).alias("service_date"),
        F.concat(F.lit('{"orgId":'), k % 40, F.lit("}")).alias("dto_json"),
        F.concat(F.lit("prio:"), F.col("o_orderpriority")).alias("sampling_stratum"),
        _priority_p().alias("inclusion_probability"), F.lit("floor").alias("sampling_reason"),
        F.lit(None).cast("string").alias("caller_request_type"),
        F.element_at(F.array(F.lit("large"), F.lit("medium"), F.lit("small"), F.lit("unknown")), (k % 4 + 1).cast("int")).alias("model_id"),
        "answer", "usage", F.lit("self").alias("eligibility_source"),
        (k % 9000).alias("total_latency_ms"))
