"""Requests: validation, mapping from stored entities, expansion to lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import computed_once, date_prefix
from ..schemas import HRT_DDL


# Text fields of a request. The first tuple of each pair is required.
DTO_TEXTS = (("dateOfBirth", "serviceDate"),
             ("consumerId", "firstName", "lastName", "ehrPatientId", "npi", "providerFirstName", "providerLastName"))
INSURANCE_TEXTS = (("memberId", "payer"),
                   ("planName", "state", "groupNumber", "insuredFirstName", "insuredLastName"))
SAMPLING_TEXTS = ("stratum", "reason")


def _variants(*names: str) -> str:
    return "struct<" + ",".join(f"{name}:variant" for name in names) + ">"


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _is_text(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def _is_number(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.lit(False))


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def validation_rules(request_type_key: str = "requestType") -> dict[str, Column]:
    """Reason -> condition that must hold, over the parts that ``validate`` splits off.
    Unknown keys are allowed everywhere."""
    lines = F.col("_lines")
    dto, ins, sampling = (lambda n: F.col(f"_dto.{n}")), (lambda n: F.col(f"_ins.{n}")), (lambda n: F.col(f"_sampling.{n}"))
    p = sampling("inclusionProbability")
    no_id = lambda h: h["hrtId"].isNull()
    no_srt = lambda h: F.coalesce(F.size(h["srtIds"]), F.lit(0)) < 1
    null_srt = lambda h: F.exists(F.coalesce(h["srtIds"], F.array().cast("array<double>")), lambda s: s.isNull())
    some = F.coalesce(F.size(lines) > 0, F.lit(False))
    rules = {"requestId": _is_text(F.col("_top.requestId")) & (_text(F.col("_top.requestId")) != ""),
             "dto": _is_object(F.col("_top.dto"))}
    rules |= {name: _is_text(dto(name)) for name in DTO_TEXTS[0]}
    rules |= {name: _is_text(ins(name)) for name in INSURANCE_TEXTS[0]}
    rules |= {"orgId": _is_number(dto("orgId")), "hrtToSrts": some,
              "hrtId": ~some | ~F.exists(lines, no_id),
              "srtIds": ~some | ~F.exists(lines, lambda h: no_srt(h) | null_srt(h)),
              "inclusionProbability": p.isNull() | (_is_number(p) & F.try_variant_get(p, "$", "double").between(0, 1))}
    optional = [(n, dto(n)) for n in DTO_TEXTS[1]] + [(n, ins(n)) for n in INSURANCE_TEXTS[1]]
    optional += [(n, sampling(n)) for n in (*SAMPLING_TEXTS, request_type_key)]
    return rules | {name: value.isNull() | _is_text(value) for name, value in optional}


def validate(feed: DataFrame, body: str = "body", request_type_key: str = "requestType") -> DataFrame:
    """Adds ``raw`` (the whole request, unknown keys included), ``reasons`` and ``is_valid``.

    The request is split into its objects once; the rules then look at single fields.
    ``request_type_key`` is the name under which the caller's sampler sends its request type.
    """
    parsed = computed_once(feed, raw=F.try_parse_json(F.col(body)))
    part = lambda path, kind: F.try_variant_get("raw", path, kind)
    split = computed_once(
        parsed, _top=part("$", _variants("requestId", "dto", "sampling")),
        _dto=part("$.dto", _variants(*DTO_TEXTS[0], *DTO_TEXTS[1], "orgId", "coverageSpend", "eligibility")),
        _ins=part("$.dto.primaryInsurance", _variants(*INSURANCE_TEXTS[0], *INSURANCE_TEXTS[1])),
        _sampling=part("$.sampling", _variants(*SAMPLING_TEXTS, "inclusionProbability", request_type_key)),
        _lines=part("$.dto.hrtToSrts", HRT_DDL))
    reasons = F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in validation_rules(request_type_key).items()]))
    reasons = F.when(F.col("raw").isNull(), F.array(F.lit("json"))).otherwise(reasons)
    return computed_once(split, reasons=reasons).withColumn("is_valid", F.size("reasons") == 0)


def accepted(validated: DataFrame, request_type_key: str = "requestType") -> DataFrame:
    """Typed columns of the valid requests."""
    dto, ins = (lambda n: _text(F.col(f"_dto.{n}"))), (lambda n: _text(F.col(f"_ins.{n}")))
    sampling = lambda n: F.col(f"_sampling.{n}")
    return validated.where("is_valid").select(
        _text(F.col("_top.requestId")).alias("request_id"),
        dto("consumerId").alias("consumer_id"), dto("firstName").alias("first_name"), dto("lastName").alias("last_name"),
        dto("dateOfBirth").alias("date_of_birth"), dto("ehrPatientId").alias("ehr_patient_id"),
        dto("serviceDate").alias("service_date"), date_prefix(dto("serviceDate")).alias("asof"),
        ins("memberId").alias("member_id"), ins("payer").alias("payer"), ins("planName").alias("plan_name"),
        ins("state").alias("state"), ins("groupNumber").alias("group_number"),
        ins("insuredFirstName").alias("insured_first_name"), ins("insuredLastName").alias("insured_last_name"),
        dto("npi").alias("npi"), dto("providerFirstName").alias("provider_first_name"),
        dto("providerLastName").alias("provider_last_name"),
        F.try_variant_get("_dto.orgId", "$", "bigint").alias("org_id"), F.col("_lines").alias("hrt_to_srts"),
        F.col("_dto.coverageSpend").alias("coverage_spend"), F.col("_dto.eligibility").alias("eligibility"),
        _text(sampling("stratum")).alias("sampling_stratum"),
        F.try_variant_get(sampling("inclusionProbability"), "$", "double").alias("inclusion_probability"),
        _text(sampling("reason")).alias("sampling_reason"), _text(sampling(request_type_key)).alias("caller_request_type"),
        F.to_json("_top.dto").alias("dto_json"), "raw")


def rejects(validated: DataFrame) -> DataFrame:
    return validated.where(~F.col("is_valid")).drop("_top", "_dto", "_ins", "_sampling", "_lines")


def request_lines(requests: DataFrame, *keep: str) -> DataFrame:
    """One row per (request, treatment, SRT) with both list positions."""
    return (requests.select("request_id", *keep, F.posexplode("hrt_to_srts").alias("hrt_pos", "h"))
            .select("request_id", *keep, "hrt_pos", F.col("h.hrtId").cast("bigint").alias("hrt_id"),
                    F.posexplode("h.srtIds").alias("srt_pos", "srt"))
            .withColumn("srt_id", F.col("srt").cast("bigint")).drop("srt"))


def scan_entities(ids: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing) of the wanted ids."""
    wanted = ids.select("id").distinct()
    return wanted.join(entities, "id"), wanted.join(entities, "id", "left_anti")


def map_entities(entities: DataFrame, now: Column, spend_override_first: bool = True) -> DataFrame:
    """Stored entity -> request columns: text casts, number casts in the nested lists, service
    date defaulting to ``now``. Which coverage-spend field goes first is a parameter, as the
    source states both orders."""
    text = lambda path: F.try_variant_get("requestinfo", path, "string")
    ins = "$.primaryInsurance"
    spend = [F.try_variant_get("requestinfo", path, "variant") for path in ("$.coverageSpendOverride", "$.coverageSpend")]
    # JSON null counts as absent, so that the other field is used.
    spend = [F.when(~F.is_variant_null(v), v) for v in (spend if spend_override_first else spend[::-1])]
    service = F.coalesce(F.nullif(text("$.serviceDate"), F.lit("")), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    lines = F.coalesce(F.try_variant_get("requestinfo", "$.hrtToSrts", HRT_DDL), F.array().cast(HRT_DDL))
    return entities.select(
        F.col("id").alias("request_id"), text("$.consumerId").alias("consumer_id"),
        text("$.firstName").alias("first_name"), text("$.lastName").alias("last_name"),
        text("$.dateOfBirth").alias("date_of_birth"), text("$.ehrPatientId").alias("ehr_patient_id"),
        service.alias("service_date"), date_prefix(service).alias("asof"),
        text(f"{ins}.memberId").alias("member_id"), text(f"{ins}.payer").alias("payer"),
        text(f"{ins}.planName").alias("plan_name"), text(f"{ins}.state").alias("state"),
        text(f"{ins}.groupNumber").alias("group_number"),
        text(f"{ins}.insuredFirstName").alias("insured_first_name"),
        text(f"{ins}.insuredLastName").alias("insured_last_name"), text("$.npi").alias("npi"),
        text("$.providerFirstName").alias("provider_first_name"),
        text("$.providerLastName").alias("provider_last_name"),
        text("$.orgId").try_cast("bigint").alias("org_id"), lines.alias("hrt_to_srts"),
        F.coalesce(*spend).alias("coverage_spend"))
