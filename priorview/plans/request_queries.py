"""Requests, eligibility tiles, gate, result rows and cost."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import eligibility as e
from ..operators import results as rs
from ..operators import scorecard as s
from ..operators import stc_rules as st
from ..operators.asof import newest
from ..schemas import BREAKDOWN_KEYS, LATER_COLUMNS, as_result_rows
from ..session import scratch_dir, stored
from ..sources import eligibility as se
from ..sources import requests as rq
from ..sources import tables as tb
from . import bindings as b
from .catalog import query
from .resolve_queries import LINES_SQL, chains
from .scorecard_queries import RESULTS_SQL, as_double


@query("request_validation", """
SELECT o_orderkey AS source_key, o_orderkey % 12 IN (0, 10, 11) AS is_valid,
       CASE o_orderkey % 12 WHEN 1 THEN 'requestId' WHEN 2 THEN 'requestId' WHEN 3 THEN 'dateOfBirth' WHEN 4 THEN 'memberId'
         WHEN 5 THEN 'hrtToSrts' WHEN 6 THEN 'srtIds' WHEN 7 THEN 'inclusionProbability' WHEN 8 THEN 'orgId' WHEN 9 THEN 'json'
         ELSE '' END AS reasons FROM orders""")
def request_validation(t):
    """S3."""
    return (rq.validate(b.request_bodies(t))
            .select("source_key", "is_valid", F.array_join("reasons", ",").alias("reasons")))


@query("request_lines", """
SELECT 'r' || o_orderkey AS request_id, 949 AS hrt_id, CASE WHEN srt_pos = 0 THEN o_custkey % 500 ELSE 7 END AS srt_id, 0 AS hrt_pos, srt_pos,
       CASE WHEN o_orderkey % 12 <> 11 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS asof,
       CASE o_orderkey % 12 WHEN 0 THEN 0.5 WHEN 10 THEN 0.0 END AS inclusion_probability,
       CASE WHEN o_orderkey % 12 = 0 THEN 'live' END AS caller_request_type
FROM orders, (VALUES (0), (1)) AS v(srt_pos) WHERE o_orderkey % 12 IN (0, 10, 11)""")
def request_lines(t):
    """Typed valid requests, one row per line; a bad date text gives no as-of date."""
    reqs = rq.accepted(rq.validate(b.request_bodies(t))).withColumn("asof", F.col("asof").cast("string"))
    return rq.request_lines(reqs, "asof", "inclusion_probability", "caller_request_type")


@query("entity_scan", """
SELECT CAST(o_orderkey AS VARCHAR) AS request_id, CAST(o_custkey AS VARCHAR) AS ehr_patient_id, CAST(o_custkey AS VARCHAR) AS member_id,
       o_orderkey % 40 AS org_id, CAST(o_orderkey AS VARCHAR) AS group_number, '1234567890' AS npi,
       CASE WHEN o_orderkey % 3 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) ELSE '2024-05-06' END AS asof,
       (o_orderkey % 5) || ':' || (o_orderkey % 9) || ',12' AS lines,
       CASE WHEN o_orderkey % 4 = 0 THEN 5 ELSE o_orderkey END AS spend_left
FROM orders WHERE o_custkey % 2 = 0""")
def entity_scan(t):
    """Wanted entities mapped to requests."""
    ids = t.orders.where(F.col("o_custkey") % 2 == 0).select(F.col("o_orderkey").cast("string").alias("id"))
    found, _ = rq.scan_entities(ids, b.entities(t))
    mapped = rq.map_entities(found, F.lit("2024-05-06 07:08:09").cast("timestamp"))
    lines = F.transform("hrt_to_srts", lambda h: F.concat(
        h["hrtId"].cast("bigint").cast("string"), F.lit(":"),
        F.array_join(F.transform(h["srtIds"], lambda x: x.cast("bigint").cast("string")), ",")))
    return mapped.select("request_id", "ehr_patient_id", "member_id", "org_id", "group_number", "npi",
                         F.col("asof").cast("string").alias("asof"), F.array_join(lines, ";").alias("lines"),
                         F.try_variant_get("coverage_spend", "$.left", "bigint").alias("spend_left"))


@query("missing_entities", """
SELECT CAST(l_orderkey AS VARCHAR) AS id FROM (SELECT DISTINCT l_orderkey FROM lineitem)
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def missing_entities(t):
    """Ids without an entity."""
    ids = t.lineitem.select(F.col("l_orderkey").cast("string").alias("id"))
    held = t.orders.where(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").cast("string").alias("id"))
    return rq.scan_entities(ids, held)[1]


@query("result_lookup", f"""WITH {RESULTS_SQL}
SELECT request_id, srt_id, CAST(est AS DOUBLE) AS estimated_patient_resp, confidence FROM results
WHERE member_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def result_lookup(t):
    """Result rows of a table of ids."""
    wanted = t.customer.where(F.col("c_mktsegment") == "MACHINERY").select(F.col("c_custkey").alias("member_id"))
    ids = tb.keep_numeric_ids(t.orders.join(wanted, F.col("o_custkey") == F.col("member_id")), "o_orderkey")
    found = tb.lookup_results(b.results(t), ids.select(F.col("o_orderkey").cast("string").alias("request_id")))
    return as_double(found.select("request_id", "srt_id", "estimated_patient_resp", "confidence"), "estimated_patient_resp")


@query("column_profile", """
SELECT 0 AS ordinal, 's_suppkey' AS column_name, 'bigint' AS data_type, COUNT(*) FILTER (WHERE s_suppkey IS NULL) AS null_count,
       CAST(MIN(s_suppkey) AS VARCHAR) AS min_value, CAST(MAX(s_suppkey) AS VARCHAR) AS max_value FROM supplier
UNION ALL SELECT 1, 's_name', 'string', COUNT(*) FILTER (WHERE s_name IS NULL), MIN(s_name), MAX(s_name) FROM supplier
UNION ALL SELECT 2, 's_nationkey', 'int', COUNT(*) FILTER (WHERE s_nationkey IS NULL), CAST(MIN(s_nationkey) AS VARCHAR), CAST(MAX(s_nationkey) AS VARCHAR) FROM supplier
UNION ALL SELECT 3, 's_acctbal', 'double', COUNT(*) FILTER (WHERE s_acctbal IS NULL), CAST(MIN(s_acctbal) AS VARCHAR), CAST(MAX(s_acctbal) AS VARCHAR) FROM supplier""")
def column_profile(t):
    """S8, without the distinct estimate, which another engine computes differently."""
    return tb.column_profile(t.supplier).select("ordinal", "column_name", "data_type", "null_count", "min_value", "max_value")


PROFILED = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("column_distincts", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) AS n_rows, COUNT(*) - COUNT({c}) AS null_count, COUNT(DISTINCT {c}) AS n_distinct, TRUE AS near FROM orders"
    for c in PROFILED))
def column_distincts(t):
    """Sketches of each year, merged, against exact counts; near is within a twentieth."""
    rows = t.orders.select(F.year("o_orderdate").alias("year"), *PROFILED)
    merged = tb.merged_profile(tb.column_sketches(rows, "year"))
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in PROFILED]))
    exact = t.orders.select(cells).where("value is not null").distinct().groupBy("column_name").agg(F.count("value").alias("n_distinct"))
    off = F.abs(F.col("distinct_estimate") - F.col("n_distinct"))
    return merged.join(exact, "column_name").select("column_name", "n_rows", "null_count", "n_distinct", (off <= 0.05 * F.col("n_distinct")).alias("near"))


@query("eligibility_requests", f"""WITH {LINES_SQL},
each AS (SELECT request_id, UNNEST(list_concat([prim], secs)) AS stc FROM per_srt UNION SELECT request_id, '30' FROM per_srt)
SELECT DISTINCT e.request_id, e.stc,
  '{{"tradingPartnerServiceId":"0' || (o_custkey % 90) || '","provider":{{"npi":"1234567890"' ||
  CASE WHEN o_orderkey % 2 = 0 THEN ',"firstName":"Ann"' ELSE '' END || ',"lastName":"Lee"}},"subscriber":{{"memberId":"M' || o_custkey || '"' ||
  CASE o_orderkey % 3 WHEN 0 THEN ',"firstName":"Ins"' WHEN 1 THEN ',"firstName":"Pat"' ELSE '' END ||
  ',"dateOfBirth":"19800203"}},"encounter":{{"serviceTypeCodes":["' || e.stc || '"],"dateOfService":"' || strftime(o_orderdate, '%Y%m%d') || '"}}}}' AS body
FROM each e JOIN orders ON e.request_id = o_orderkey WHERE o_custkey % 7 <> 0""")
def eligibility_requests(t):
    """S10."""
    k = F.col("o_orderkey")
    reqs = t.orders.select(
        k.alias("request_id"), F.when(F.col("o_custkey") % 7 != 0, F.concat(F.lit("0"), F.col("o_custkey") % 90)).alias("payer_id"),
        F.lit("1234567890").alias("npi"), F.when(k % 2 == 0, "Ann").otherwise("").alias("provider_first_name"),
        F.lit("Lee").alias("provider_last_name"), F.concat(F.lit("M"), F.col("o_custkey")).alias("member_id"),
        F.when(k % 3 == 0, "Ins").when(k % 3 == 2, "").alias("insured_first_name"), F.lit("Pat").alias("first_name"),
        F.lit(None).cast("string").alias("insured_last_name"), F.lit(None).cast("string").alias("last_name"),
        F.lit("1980-02-03").alias("date_of_birth"), b.day("o_orderdate").alias("asof"))
    return se.eligibility_requests(reqs, chains(t))


K_SQL = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
TILES_SQL = f"""ev AS (SELECT event_id AS request_id, event_type AS ty, {K_SQL} AS k,
    CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR) AS v FROM events),
own AS (SELECT request_id, k, v, pos, (k + pos) % 5 AS place FROM ev, (VALUES (0), (1)) AS p(pos) WHERE ty NOT IN ('view', 'click')),
tiles AS (
  SELECT request_id, pos, stc, TRUE AS ok, CAST(NULL AS VARCHAR) AS error, 'forwarded' AS eligibility_source
  FROM ev, (VALUES (0, '30'), (1, '98'), (2, '98')) AS p(pos, stc) WHERE ty = 'view'
  UNION ALL SELECT request_id, 0, '30', TRUE, NULL, 'forwarded' FROM ev WHERE ty = 'click'
  UNION ALL SELECT request_id, pos, CASE pos WHEN 0 THEN '30' ELSE '98' END, place IN (3, 4),
    CASE place WHEN 0 THEN 'HTTP 400: {{"message":"no provider"}}' WHEN 1 THEN 'AAA: [{{"code":"44"}}]' WHEN 2 THEN 'response is no JSON' END,
    'self' FROM own)"""


@query("eligibility_adapter", f"""WITH {TILES_SQL} SELECT * FROM tiles""")
def eligibility_adapter(t):
    """S9, D7, D8."""
    return b.tiles(t).drop("response")


TILES_FLAT_SQL = """SELECT request_id, 0 AS pos, '30' AS stc, n AS line_no, ['C', 'A', 'G'][n + 1] AS code,
       CASE n WHEN 0 THEN CAST(v AS DOUBLE) END AS amount, CASE n WHEN 1 THEN 0.2 END AS percent
FROM ev, (VALUES (0), (1), (2)) AS p(n) WHERE ty = 'view'
UNION ALL SELECT request_id, 1, '98', 0, 'B', k, NULL FROM ev WHERE ty = 'view'
UNION ALL SELECT request_id, 0, '30', 0, 'C', k + 0.5, NULL FROM ev WHERE ty = 'click'
UNION ALL SELECT request_id, pos, CASE pos WHEN 0 THEN '30' ELSE '98' END, 0, 'B', CAST(v AS DOUBLE), NULL FROM own WHERE place = 4"""


@query("tiles_flat", f"WITH {TILES_SQL} {TILES_FLAT_SQL}")
def tiles_flat(t):
    """D17."""
    return as_double(e.tile_benefits(b.tiles(t)).drop("period", "level"), "amount", "percent")


@query("group_number", f"""WITH {TILES_SQL}, asked AS (SELECT event_id AS request_id, CASE WHEN {K_SQL} % 5 = 0 THEN 'REQ' END AS g FROM events)
SELECT ev.request_id, CASE WHEN ty = 'view' THEN CASE WHEN k % 3 <> 0 THEN 'G' || k ELSE 'P' || k END
    WHEN ty = 'click' THEN 'P' || k WHEN g IS NOT NULL THEN g WHEN k % 5 = 4 THEN 'S' || k END AS group_number
FROM ev JOIN asked USING (request_id)""")
def group_number(t):
    """D9."""
    return e.group_numbers(b.forwarded_requests(t), b.tiles(t))


GATE_SQL = """g AS (SELECT request_id, COUNT(*) FILTER (WHERE ok) AS ok_tiles, arg_min(error, pos) FILTER (WHERE NOT ok) AS err FROM tiles GROUP BY 1),
srt_line AS (SELECT DISTINCT request_id, hrt, srt FROM ln),
gated AS (SELECT l.request_id, l.hrt, l.srt, p.prim, COALESCE(g.err, 'no tile came back') AS err,
    CASE WHEN s.p_partkey % 29 <> 0 THEN s.p_name END AS srt_name
  FROM srt_line l JOIN per_srt p USING (request_id, srt) LEFT JOIN g USING (request_id) LEFT JOIN part s ON s.p_partkey = l.srt
  WHERE COALESCE(g.ok_tiles, 0) = 0)"""
GATE_REASON_SQL = ("'Left unpriced, as benefits are unknown: ' || err || '. Earlier claims do not replace them.' || "
                   "COALESCE(' Item: ' || srt_name || '.', '') || ' Service type: ' || prim || '.'")


def _gated_lines(t):
    """The lines of requests without a good tile, with their chains and names. A line meets the gate first,
    and only what is shut gets a chain: that of the last line listed for its (request, SRT)."""
    blocked = e.gate(b.request_lines(t).where("srt_id is not null"), b.tiles(t)).where(~F.col("gate_open"))
    listed = Window.partitionBy("request_id", "srt_id").orderBy(newest("line_no"))
    last = F.first(F.struct("org_id", "payer", "hrt_id", "hrt_name")).over(listed)
    lines = (blocked.withColumn("_last", last)
             .groupBy("request_id", F.col("hrt_id").alias("_hrt"), "srt_id").agg(F.any_value("_last").alias("_last"), F.any_value("gate_error").alias("gate_error"))
             .select("request_id", "_hrt", "srt_id", "gate_error", "_last.*"))
    return (st.resolve_chains(lines, b.srt(t)).select("request_id", F.col("_hrt").alias("hrt_id"), "srt_id", "gate_error", "primary")
            .join(b.srt(t).select("srt_id", "srt_name").hint("merge"), "srt_id", "left"))


@query("gate_rows", f"""WITH {TILES_SQL}, {LINES_SQL}, {GATE_SQL}
SELECT CAST(request_id AS VARCHAR) AS request_id, hrt AS hrt_id, srt AS srt_id, 'UNABLE_TO_PRICE' AS confidence, 'COMPLETED' AS status,
  {GATE_REASON_SQL} AS reasoning, 'no answer to build on: ' || err AS breakdown, 0 AS input_tokens, 0.0 AS estimated_cost_usd
FROM gated""")
def gate_rows(t):
    """Every line of a request without a good tile."""
    lines = _gated_lines(t).withColumns({"request_id": F.col("request_id").cast("string"), "service_date": F.lit("2024-02-01"),
                                         "dto_json": F.lit("{}")})
    rows = rs.gated_rows(lines, rs.version_columns("0123456789abcdef", None))
    return as_double(rows.select("request_id", "hrt_id", "srt_id", "confidence", "status", "reasoning",
                                 F.try_variant_get("source_breakdown", f"$.{BREAKDOWN_KEYS[0]}", "string").alias("breakdown"),
                                 "input_tokens", "estimated_cost_usd"), "estimated_cost_usd")


def _runs(t):
    answers = rs.parse_answers(b.model_answers(t))
    return rs.with_failure(answers.withColumns(rs.normalize_usage(F.col("usage"))))


ANSWERS_SQL = """ans AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS request_id, o_totalprice, o_orderpriority,
    o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 AS bad, o_orderkey * 7 % 100003 AS tin, o_orderkey * 3 % 5003 AS tout,
    CASE WHEN o_orderkey % 6 IN (0, 1) THEN o_orderkey % 4001 ELSE 0 END AS tcache,
    CASE WHEN o_orderkey % 17 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS pricing_date,
    ['large', 'medium', 'small', 'unknown'][o_orderkey % 4 + 1] AS model_id FROM orders),
cost AS (SELECT *, CAST(ROUND(CAST(CASE model_id WHEN 'medium' THEN tin * 30 + tout * 150 + tcache * 3
    WHEN 'small' THEN tin * 10 + tout * 50 + tcache * 1 ELSE tin * 50 + tout * 250 + tcache * 5 END AS DECIMAL(18,0)) / CAST(10 AS DECIMAL(4,0)), 0) AS BIGINT) AS micro FROM ans)"""


@query("result_rows", f"""WITH {ANSWERS_SQL}
SELECT request_id, request_id AS run_id, k % 7 AS hrt_id, k % 50 + n AS srt_id,
       CASE WHEN k % 5 <> 0 THEN CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) END AS estimated_patient_resp,
       CASE WHEN k % 5 = 0 THEN 'UNABLE_TO_PRICE' WHEN k % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS confidence,
       tin AS input_tokens, tout AS output_tokens, tcache AS cache_read_tokens, micro / 1000000.0 AS estimated_cost_usd, model_id,
       pricing_date, left(sha256('{{"orgId":' || (k % 40) || '}}'), 16) AS dto_digest, '0123456789ab' AS pricer_version,
       CASE WHEN k % 4 = 0 THEN '["w1","w2"]' ELSE '[]' END AS warnings, 'prio:' || o_orderpriority AS sampling_stratum
FROM cost, (VALUES (0), (1)) AS p(n) WHERE NOT bad AND pricing_date IS NOT NULL""")
def result_rows(t):
    """D11, D13, D14, D15, D27."""
    rows = rs.priced_rows(_runs(t), rs.model_rates(t.spark), rs.version_columns(" 0123456789abcdef ", ""))
    out = rows.select("request_id", "run_id", "hrt_id", "srt_id", "estimated_patient_resp", "confidence", "input_tokens",
                      "output_tokens", "cache_read_tokens", "estimated_cost_usd", "model_id",
                      F.col("pricing_date").cast("string").alias("pricing_date"), "dto_digest", "pricer_version",
                      F.to_json("warnings").alias("warnings"), "sampling_stratum")
    return as_double(out, "estimated_patient_resp", "estimated_cost_usd")


FAILURE_SQL = """CASE WHEN pricing_date IS NULL THEN 'no calendar date at the start of the service date: soon'
    WHEN bad THEN 'a price breaks the answer schema' END"""


@query("error_rows", f"""WITH {ANSWERS_SQL}
SELECT request_id, 'UNABLE_TO_PRICE' AS confidence, 'ERROR' AS status, 'none' AS eligibility_source, pricing_date, {FAILURE_SQL} AS error_message
FROM ans WHERE bad OR pricing_date IS NULL""")
def error_rows(t):
    """Runs with a bad date or an answer that breaks the schema."""
    rows = rs.error_rows(_runs(t), rs.version_columns(None, None))
    return rows.select("request_id", "confidence", "status", "eligibility_source",
                       F.col("pricing_date").cast("string").alias("pricing_date"), "error_message")


@query("result_table", f"""WITH {TILES_SQL}, {LINES_SQL}, {GATE_SQL}, {ANSWERS_SQL},
shut AS (SELECT DISTINCT request_id FROM gated),
early AS (SELECT 'old-' || o_orderkey AS request_id, CAST(o_custkey AS BIGINT) AS srt_id, CAST(o_totalprice AS DECIMAL(12,2)) AS est,
    'COMPLETED' AS status, NULL AS error_message, NULL AS pricer_version, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS pricing_date
  FROM orders WHERE o_orderkey % 50 = 0)
SELECT request_id, srt_id, CAST(est AS DOUBLE) AS estimated_patient_resp, status, error_message, pricer_version, pricing_date FROM early
UNION ALL SELECT request_id, k % 50 + n, CASE WHEN k % 5 <> 0 THEN CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) END, 'COMPLETED', NULL, '0123456789ab', pricing_date
FROM ans, (VALUES (0), (1)) AS p(n) WHERE NOT bad AND pricing_date IS NOT NULL AND k NOT IN (SELECT request_id FROM shut)
UNION ALL SELECT request_id, NULL, NULL, 'ERROR', {FAILURE_SQL}, '0123456789ab', pricing_date
FROM ans WHERE pricing_date IS NULL OR bad AND k NOT IN (SELECT request_id FROM shut)
UNION ALL SELECT a.request_id, g.srt, NULL, 'COMPLETED', NULL, '0123456789ab', a.pricing_date
FROM ans a JOIN gated g ON g.request_id = a.k WHERE a.pricing_date IS NOT NULL""")
def result_table(t):
    """Priced, gated and failed requests in one stored table, over a part
    of it that an earlier version wrote without the later columns. A bad date fails a request; else
    a shut gate leaves its lines unpriced; else its answer counts. Parsed answers and gated lines
    are stored, as each of the four kinds of rows would work them out again."""
    home = scratch_dir(t.spark)
    version = rs.version_columns("0123456789abcdef", None)
    gated = stored(_gated_lines(t).withColumn("request_id", F.col("request_id").cast("string")), "gated")
    shut = gated.select("request_id").distinct().withColumn("is_shut", F.lit(True))
    runs = stored(_runs(t).drop("answer", "usage").join(shut, "request_id", "left"), "runs")
    dated = F.col("failure").isNull() | F.col("failure").eqNullSafe(F.col("parse_error"))
    reached = runs.where(dated & F.col("is_shut").isNull())
    undated = runs.where(~dated)
    request = runs.where(dated).select("request_id", "service_date", "dto_json", *rs.SAMPLING)
    early = t.orders.where(F.col("o_orderkey") % 50 == 0).select(
        F.concat(F.lit("old-"), F.col("o_orderkey")).alias("request_id"), F.col("o_custkey").cast("bigint").alias("srt_id"),
        b.money("o_totalprice").alias("estimated_patient_resp"), F.lit("COMPLETED").alias("status"),
        b.day("o_orderdate").alias("pricing_date"))
    old = as_result_rows(early).drop(*LATER_COLUMNS)
    old.write.parquet(f"{home}/results")
    new = rs.all_rows(rs.priced_rows(reached, rs.model_rates(t.spark), version), rs.error_rows(reached, version),
                      rs.error_rows(undated, version), rs.gated_rows(gated.join(request, "request_id"), version))
    tb.append_results(new, f"{home}/results", partition=None)
    rows = tb.read_results(t.spark, f"{home}/results")
    return as_double(rows.select("request_id", "srt_id", "estimated_patient_resp", "status", "error_message", "pricer_version",
                                 F.col("pricing_date").cast("string").alias("pricing_date")), "estimated_patient_resp")


@query("token_cost", f"""WITH {ANSWERS_SQL}
SELECT request_id, model_id, tin AS input_tokens, tout AS output_tokens, tcache AS cache_read_tokens, micro / 1000000.0 AS estimated_cost_usd
FROM cost""")
def token_cost(t):
    """D13, D14."""
    usage = b.model_answers(t).withColumns(rs.normalize_usage(F.col("usage")))
    out = rs.token_cost(usage, rs.model_rates(t.spark))
    return as_double(out.select("request_id", "model_id", "input_tokens", "output_tokens", "cache_read_tokens",
                                "estimated_cost_usd"), "estimated_cost_usd")


@query("conversation_usage", """
SELECT conv_id, CAST(SUM(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) AS BIGINT) AS input_tokens,
       CAST(SUM(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS output_tokens, CAST(0 AS BIGINT) AS cache_read_tokens
FROM conversations GROUP BY conv_id""")
def conversation_usage(t):
    """Usage of all calls of a run, missing parts as 0."""
    calls = t.conversations.select("conv_id", F.when(F.col("role") == "user", F.length("text")).alias("input_tokens"),
                                   F.when(F.col("role") == "assistant", F.length("text")).alias("output_tokens"),
                                   F.lit(None).cast("bigint").alias("cache_read_tokens"))
    return rs.sum_usage(calls, ["conv_id"])


def _costed_results(t):
    """Stored rows with run-level cost columns that repeat on each line."""
    key = F.col("request_id").cast("bigint")
    usage = b.results(t).withColumns({"run_id": F.col("request_id"), "input_tokens": key * 7 % 100003,
                                      "output_tokens": key * 3 % 5003, "cache_read_tokens": key % 4001,
                                      "total_latency_ms": key % 9000})
    return rs.token_cost(usage.withColumn("model_id", F.element_at(
        F.array(F.lit("large"), F.lit("medium"), F.lit("small"), F.lit("unknown")), (key % 4 + 1).cast("int"))),
        rs.model_rates(t.spark))


RUN_SQL = """run AS (SELECT l_orderkey AS k, ['large', 'medium', 'small', 'unknown'][l_orderkey % 4 + 1] AS model_id,
    l_orderkey * 7 % 100003 AS tin, l_orderkey * 3 % 5003 AS tout, l_orderkey % 4001 AS tc, l_orderkey % 9000 AS ms
  FROM (SELECT DISTINCT l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)),
rc AS (SELECT *, CAST(ROUND(CAST(CASE model_id WHEN 'medium' THEN tin * 30 + tout * 150 + tc * 3 WHEN 'small' THEN tin * 10 + tout * 50 + tc
    ELSE tin * 50 + tout * 250 + tc * 5 END AS DECIMAL(18,0)) / CAST(10 AS DECIMAL(4,0)), 0) AS BIGINT) AS micro FROM run),
costs AS (SELECT model_id, COUNT(*) AS n_runs, SUM(micro) / 1000000.0 AS cost_usd, CAST(SUM(ms) AS BIGINT) AS latency_ms,
    CAST(SUM(tin) AS BIGINT) AS input_tokens, CAST(SUM(tout) AS BIGINT) AS output_tokens, CAST(SUM(tc) AS BIGINT) AS cache_read_tokens
  FROM rc GROUP BY model_id)"""


@query("run_cost", f"""WITH {RUN_SQL} SELECT * FROM costs""")
def run_cost(t):
    """A12."""
    return as_double(rs.run_costs(_costed_results(t), ["model_id"]), "cost_usd")


@query("model_cost_accuracy", f"""WITH {RUN_SQL}, {RESULTS_SQL},
act AS (SELECT CAST(o_orderkey AS VARCHAR) AS request_id, CAST(o_totalprice AS DECIMAL(12,2)) / 50 AS actual FROM orders),
tot AS (SELECT request_id, SUM(est) AS est, CAST(1 / COALESCE(MIN(p), 1) AS BIGINT) AS w FROM results
        WHERE status = 'COMPLETED' GROUP BY request_id HAVING SUM(est) IS NOT NULL),
j AS (SELECT ['large', 'medium', 'small', 'unknown'][CAST(request_id AS BIGINT) % 4 + 1] AS model_id, w,
        est - CAST(ROUND(CAST(actual AS DECIMAL(18,6)), 2) AS DECIMAL(12,2)) AS e1 FROM tot JOIN act USING (request_id))
SELECT c.model_id, n_runs, cost_usd, n_sampled, wmae FROM costs c LEFT JOIN
  (SELECT model_id, COUNT(*) AS n_sampled, CAST(ROUND(CAST(CAST(SUM(ABS(e1) * w) AS DOUBLE) / SUM(w) AS DECIMAL(18,6)), 2) AS DOUBLE) AS wmae
   FROM j GROUP BY model_id) a ON a.model_id = c.model_id""")
def model_cost_accuracy(t):
    """Cost per run-model next to the weighted error on the same traffic."""
    from ..functions import sampling_weight

    costed = _costed_results(t)
    costs = rs.run_costs(costed, ["model_id"]).select("model_id", "n_runs", "cost_usd")
    totals = (costed.where(F.col("status") == "COMPLETED").groupBy("request_id", "model_id")
              .agg(F.sum("estimated_patient_resp").alias("estimate"), F.min("inclusion_probability").alias("p"))
              .where(F.col("estimate").isNotNull()))
    actual = t.orders.select(F.col("o_orderkey").cast("string").alias("request_id"),
                             F.round(b.money("o_totalprice") / F.lit(50).cast("decimal(4,0)"), 2).cast("decimal(12,2)").alias("actual"))
    errors = (totals.join(actual, "request_id").withColumn("estimate_err", F.col("estimate") - F.col("actual"))
              .withColumn("w", sampling_weight("p")))
    scored = s.line_level_scorecard(errors, ["model_id"]).select("model_id", "n_sampled", F.col("estimate_wmae").alias("wmae"))
    return as_double(costs.join(scored, "model_id", "left"), "cost_usd", "wmae")
