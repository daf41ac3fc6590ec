"""Schemas of requests, model answers and stored result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Column order and types of the stored result rows.
RESULT_COLUMNS: tuple[tuple[str, str], ...] = (
    ("request_id", "string"), ("run_id", "string"), ("hrt_id", "bigint"), ("srt_id", "bigint"),
    ("estimated_patient_resp", "decimal(12,2)"), ("benefit_type", "string"), ("confidence", "string"),
    ("reasoning", "string"), ("source_breakdown", "variant"), ("warnings", "variant"),
    ("total_latency_ms", "bigint"), ("step_latency_ms", "variant"), ("input_tokens", "bigint"),
    ("output_tokens", "bigint"), ("cache_read_tokens", "bigint"), ("estimated_cost_usd", "decimal(12,6)"),
    ("model_id", "string"), ("pricing_date", "date"), ("dto_digest", "string"), ("status", "string"),
    ("error_message", "string"), ("sampling_stratum", "string"), ("inclusion_probability", "double"),
    ("sampling_reason", "string"), ("caller_request_type", "string"), ("pricer_version", "string"),
    ("pricer_commit_url", "string"), ("eligibility_source", "string"), ("created_at", "timestamp_ntz"),
)

# Columns that tables written by earlier versions may lack.
LATER_COLUMNS = ("sampling_stratum", "inclusion_probability", "sampling_reason", "caller_request_type",
                 "pricer_version", "pricer_commit_url", "eligibility_source")

HRT_DDL = "array<struct<hrtId:double,srtIds:array<double>>>"
# Keys of a price's source breakdown, as model answers carry them.
BREAKDOWN_KEYS = ("stedi", "ownHistoricals", "groupHistoricals", "webSearch", "allowableSource")
PRICE_DDL = ("array<struct<hrtId:double,srtId:double,estimatedPatientResponsibility:variant,benefitType:string,"
             "confidence:string,reasoning:string,sourceBreakdown:struct<"
             + ",".join(f"{key}:string" for key in BREAKDOWN_KEYS) + ">>>")

CONFIDENCE_LEVELS = ("HIGH", "MEDIUM", "LOW", "UNABLE_TO_PRICE")
UNABLE = "UNABLE_TO_PRICE"


def as_result_rows(df: DataFrame) -> DataFrame:
    """The result columns in order and type; absent ones become NULL."""
    have = set(df.columns)
    return df.select(*[(F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)
                       for name, kind in RESULT_COLUMNS])
