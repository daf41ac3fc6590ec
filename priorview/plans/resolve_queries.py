"""Payer, provider and service-type resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as lg
from ..operators import resolve as r
from ..operators import stc_rules as st
from . import bindings as b
from .catalog import ORACLES, query
from .history_queries import LOOKBACK_SQL, MEMBER_FACTS_SQL, ledger_sql

PAYER_SQL = """payer AS (
  SELECT CASE WHEN p_size <> 9 THEN lpad(CAST(p_size AS VARCHAR), 3, '0') || ', ' || lpad(CAST(p_partkey % 7 AS VARCHAR), 2, '0')
              || ',, ' || lpad(CAST(p_size AS VARCHAR), 3, '0') END AS code, p_name AS name FROM part),
preq AS (
  SELECT o_orderkey AS request_id,
         CASE o_orderkey % 4 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN upper(split_part(p_name, ' ', 2))
              WHEN 2 THEN p_type ELSE left(p_name, 2) || '%' END AS payer,
         CASE o_orderkey % 5 WHEN 0 THEN 'bolt' WHEN 1 THEN 'ri' WHEN 2 THEN 'RED' WHEN 3 THEN '' END AS state
  FROM orders JOIN part ON o_custkey = p_partkey),
texts AS (SELECT DISTINCT lower(payer) AS needle FROM preq),
matched AS (SELECT * FROM (
  SELECT needle, name, code, ROW_NUMBER() OVER (PARTITION BY needle ORDER BY name, code NULLS LAST) AS row_no
  FROM texts JOIN payer ON contains(lower(name), needle)) WHERE row_no <= 5)"""

CAND_SQL = PAYER_SQL + """,
asked AS (SELECT DISTINCT lower(payer) AS needle, state FROM preq),
prow AS (SELECT a.needle, a.state, m.row_no, m.code,
           CASE WHEN m.row_no = MIN(CASE WHEN a.state <> '' AND contains(lower(m.name), lower(a.state)) THEN m.row_no END)
             OVER (PARTITION BY a.needle, a.state) THEN 0 ELSE m.row_no END AS ord
         FROM asked a JOIN matched m ON m.needle = a.needle),
parts AS (SELECT needle, state, ord, UNNEST(string_split(code, ',')) AS raw, generate_subscripts(string_split(code, ','), 1) AS nth
          FROM prow),
codes AS (SELECT needle, state, trim(raw) AS code, MIN(ord * 1000 + nth) AS place FROM parts WHERE trim(raw) <> '' GROUP BY 1, 2, 3),
cand AS (SELECT q.request_id, c.code, ROW_NUMBER() OVER (PARTITION BY q.request_id ORDER BY c.place) AS nth
         FROM preq q JOIN codes c ON c.needle = lower(q.payer) AND c.state IS NOT DISTINCT FROM q.state)"""


@query("payer_lookup_top5", f"""WITH {PAYER_SQL}
SELECT needle, row_no, name AS payer_name, code AS availity_payer_code FROM matched""")
def payer_lookup_top5(t):
    """J1, F4, T3."""
    return r.payer_matches(b.payer_requests(t), b.payers(t), n=5)


@query("payer_candidates", f"""WITH {CAND_SQL}
SELECT q.request_id, COALESCE(string_agg(c.code, '|' ORDER BY c.nth), '') AS candidates
FROM preq q LEFT JOIN cand c USING (request_id) GROUP BY q.request_id""")
def payer_candidates(t, n=5):
    """D1, from the first ``n`` payer rows of a text."""
    return (r.request_candidates(b.payer_requests(t), b.payers(t), n=n)
            .select("request_id", F.array_join("candidates", "|").alias("candidates")))


@query("payer_first_ok", f"""WITH {CAND_SQL},
probe AS (SELECT *, (request_id + CAST(code AS INTEGER)) % 3 = 0 AS ok FROM cand WHERE request_id % 7 <> 0)
SELECT q.request_id, COALESCE(arg_min(p.code, p.nth) FILTER (WHERE p.ok), arg_min(c.code, c.nth)) AS payer_id,
       COUNT(*) FILTER (WHERE p.ok) > 0 AS accepted
FROM preq q LEFT JOIN cand c ON c.request_id = q.request_id
LEFT JOIN probe p ON p.request_id = c.request_id AND p.code = c.code GROUP BY q.request_id""")
def payer_first_ok(t, n=5):
    """D2 over a table of probe outcomes, from the first ``n`` payer rows of a text."""
    requests = b.payer_requests(t)
    positions = r.code_positions(requests, b.payers(t), n=n)
    asked = requests.where(F.col("request_id") % 7 != 0).select("request_id", F.lower("payer").alias("needle"), F.col("state").alias("_state"))
    probes = (asked.join(positions, "needle").where(F.col("_state").eqNullSafe(F.col("state"))).select("request_id", "code")
              .withColumn("ok", (F.col("request_id") + F.col("code").cast("int")) % 3 == 0))
    return r.first_accepted(requests, positions, probes)


@query("payer_candidates_all", ORACLES["payer_candidates"].replace(" WHERE row_no <= 5", ""))
def payer_candidates_all(t):
    """From all payer rows of a text."""
    return payer_candidates(t, None)


@query("payer_first_ok_all", ORACLES["payer_first_ok"].replace(" WHERE row_no <= 5", ""))
def payer_first_ok_all(t):
    """From all payer rows of a text."""
    return payer_first_ok(t, None)


@query("provider_resolution", """
WITH dp AS (SELECT s_nationkey AS org_id,
         CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN 'TEST' || s_suppkey
              ELSE '1' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') END AS npi,
         CASE s_suppkey % 3 WHEN 0 THEN 'NY' WHEN 1 THEN 'nj' END AS state FROM supplier),
pv AS (SELECT '1' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS npi, CASE WHEN s_suppkey % 6 <> 0 THEN 'F' || i END AS fn,
              'L' || (s_suppkey % 11) || '-' || i AS ln
       FROM supplier, (VALUES (0), (1)) AS v(i) WHERE i = 0 OR s_suppkey % 4 = 0),
person AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY npi ORDER BY ln NULLS LAST, fn NULLS LAST) AS rn FROM pv) WHERE rn = 1),
req AS (SELECT o_orderkey AS request_id, c_nationkey AS org_id,
          CASE o_orderkey % 4 WHEN 0 THEN ' 1' || lpad(CAST(o_custkey % 100 AS VARCHAR), 9, '0') || ' '
               WHEN 1 THEN '12345ABC90' WHEN 2 THEN '123456789' END AS npi,
          CASE o_orderkey % 3 WHEN 0 THEN 'Ann' WHEN 1 THEN '' END AS rf, CASE WHEN o_orderkey % 5 = 0 THEN 'Request' END AS rl,
          CASE o_orderkey % 6 WHEN 0 THEN 'ny' WHEN 1 THEN 'NJ' WHEN 2 THEN '' WHEN 3 THEN 'TX' END AS state
        FROM orders JOIN customer ON o_custkey = c_custkey),
own AS (SELECT *, CASE WHEN regexp_full_match(trim(npi), '[0-9]{10}') THEN trim(npi) END AS own FROM req),
pick AS (SELECT o.*, d.npi AS dnpi, ROW_NUMBER() OVER (PARTITION BY o.request_id
           ORDER BY CASE WHEN o.state <> '' AND lower(COALESCE(d.state, '')) = lower(o.state) THEN 0 ELSE 1 END,
                    d.npi, d.state NULLS LAST) AS rn
         FROM own o LEFT JOIN dp d ON d.org_id = o.org_id AND d.npi IS NOT NULL)
SELECT p.request_id, CASE WHEN own IS NOT NULL THEN own WHEN regexp_full_match(dnpi, '[0-9]{10}') THEN dnpi END AS npi,
       CASE WHEN own IS NOT NULL AND rf <> '' THEN rf WHEN own IS NOT NULL THEN n.fn ELSE COALESCE(rf, n.fn) END AS first_name,
       CASE WHEN own IS NOT NULL AND rf <> '' THEN rl ELSE COALESCE(rl, n.ln) END AS last_name
FROM pick p LEFT JOIN person n ON n.npi = COALESCE(own, dnpi) WHERE p.rn = 1""")
def provider_resolution(t):
    """J2, J3, D3, F10."""
    return r.resolve_provider(b.provider_requests(t), b.default_providers(t), b.providers(t))


LINES_SQL = """ln AS (
  SELECT l_orderkey AS request_id, c_nationkey + (l_orderkey % 2) * 20 AS org, lower(
           ['Aetna PPO','BCBS of NJ','Cigna','UHC Choice','Medicaid NJ','Oxford Health','CareFirst BlueCross','United','GHI',
            'Blue Cross Cigna','NJ Plan','New Jersey Medicaid'][o_custkey % 12 + 1]) AS pay,
         l_partkey % 90 + 935 AS hrt, CASE l_linenumber WHEN 7 THEN 'Weight Management visit'
           WHEN 6 THEN 'OBSTETRICS - new patient' ELSE '' END AS nm, l_partkey AS srt, l_linenumber AS line_no
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
dflt AS (SELECT p_partkey AS srt,
    COALESCE(CASE p_size % 5 WHEN 1 THEN '2' WHEN 2 THEN '98' WHEN 3 THEN 'MH' WHEN 4 THEN '5' END, '30') AS dp,
    CASE p_size % 4 WHEN 0 THEN ['96', '98'] WHEN 1 THEN ['UC'] ELSE CAST([] AS VARCHAR[]) END AS ds
  FROM part WHERE p_partkey % 29 <> 0),
f AS (SELECT ln.*, COALESCE(dp, '30') AS dp, COALESCE(ds, CAST([] AS VARCHAR[])) AS ds,
    hrt IN (949, 950, 1007, 1008) OR regexp_matches(nm, '(?i)obstetrics.*(follow up|new patient)') AS ob,
    srt IN (160, 465, 356, 276, 337, 353, 277) AS us, srt IN (131, 141, 142, 164, 2011, 2035) AS vis, srt IN (204, 407, 436) AS pain,
    contains(pay, 'bcbs') OR contains(pay, 'blue cross') AS blue, contains(pay, 'uhc') OR contains(pay, 'united') AS united,
    contains(pay, 'cigna') AS cigna, contains(pay, 'aetna') AS aetna, org IN (11, 12, 13, 14, 18) AS surg
  FROM ln LEFT JOIN dflt USING (srt)),
ruled AS (SELECT *, CASE
    WHEN org = 7 THEN 1 WHEN org = 16 AND contains(pay, 'oxford') THEN 2 WHEN org = 16 THEN 3
    WHEN org = 10 AND ob AND blue THEN 4 WHEN org = 10 AND ob AND (aetna OR contains(pay, 'ghi') OR contains(pay, 'hip')) THEN 5
    WHEN org = 10 AND ob THEN 6 WHEN org = 10 AND us THEN 7 WHEN org = 10 AND hrt IN (1020, 1019, 939, 999) THEN 8
    WHEN org = 9 AND us THEN 9 WHEN org IN (23, 31, 32, 33, 34) AND regexp_matches(nm, '(?i)weight management') THEN 10
    WHEN org IN (23, 31, 32, 33, 34) THEN 11
    WHEN org IN (24, 43, 29) AND contains(pay, 'medicaid') AND (contains(pay, 'nj') OR contains(pay, 'new jersey')) THEN 12
    WHEN org IN (24, 43, 29) THEN 13 WHEN org = 27 AND contains(pay, 'carefirst') AND vis THEN 14
    WHEN org = 39 AND contains(pay, 'carefirst') AND vis THEN 15
    WHEN surg AND pain AND blue THEN 16 WHEN surg AND pain AND united THEN 17 WHEN surg AND pain AND cigna THEN 18
    WHEN surg AND pain AND aetna THEN 19 WHEN surg AND pain THEN 20 WHEN surg AND blue THEN 21 WHEN surg AND cigna THEN 22
    WHEN surg AND united THEN 23 WHEN surg AND aetna THEN 24 WHEN surg THEN 25 WHEN org = 44 THEN 26 ELSE 27 END AS rule_no FROM f),
outcome(rule_no, p, s) AS (VALUES (1, 'MH', NULL), (2, '96', '98,A6,A4'), (3, 'A6', 'MH,A4'), (4, 'BU', 'BV'), (5, '69', 'BV'),
    (6, '69', NULL), (7, '5', '62,BV'), (8, '98', '96'), (9, '5', '62,BV'), (10, NULL, NULL), (11, '96', '98'), (12, '98', 'UC'),
    (13, 'UC', '98'), (14, NULL, 'BY+'), (15, NULL, 'BY+'), (16, '7', '2,98'), (17, '7', '96,98,1'), (18, '30', '7,98'),
    (19, '98', '7,2'), (20, '7', '2,98'), (21, '2', '8,1'), (22, '2', '30,1'), (23, '2', '96,8,1'), (24, '98', '7,2'),
    (25, '2', '1,98'), (26, '98', '96'), (27, NULL, NULL)),
chain AS (SELECT request_id, srt, hrt, line_no, rule_no, COALESCE(p, dp) AS prim,
    CASE WHEN s IS NULL THEN ds WHEN s = 'BY+' THEN list_concat(['BY'], ds) ELSE string_split(s, ',') END AS secs
  FROM ruled JOIN outcome USING (rule_no)),
per_srt AS (SELECT request_id, srt, arg_max(rule_no, line_no) AS rule_no, arg_max(prim, line_no) AS prim, arg_max(secs, line_no) AS secs
  FROM chain GROUP BY request_id, srt)"""


def chains(t):
    return st.resolve_chains(st.last_listed(b.request_lines(t), ["line_no"]), b.srt(t)).select(*st.CHAIN)


@query("stc_chain_overrides", f"""WITH {LINES_SQL}
SELECT request_id, srt AS srt_id, rule_no, prim AS "primary", array_to_string(secs, ',') AS secondaries FROM per_srt""")
def stc_chain_overrides(t):
    """J4, D4, D5, F5."""
    return chains(t).select("request_id", "srt_id", "rule_no", "primary",
                            F.array_join("secondaries", ",").alias("secondaries"))


@query("stc_lists", f"""WITH {LINES_SQL},
each AS (SELECT request_id, srt, UNNEST(list_concat([prim], secs)) AS stc,
                generate_subscripts(list_concat([prim], secs), 1) AS nth FROM per_srt),
firsts AS (SELECT request_id, stc, MIN(srt * 100 + nth) AS place FROM each GROUP BY 1, 2)
SELECT request_id, string_agg(stc, ',' ORDER BY place) AS stcs FROM firsts GROUP BY request_id""")
def stc_lists(t):
    """A10."""
    return st.stc_lists(chains(t)).select("request_id", F.array_join("stcs", ",").alias("stcs"))


CONTEXT_SQL = """bc AS (SELECT '992' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code,
    CASE WHEN n_nationkey % 8 = 0 THEN 'Surgery' ELSE r_name END AS grp,
    CASE WHEN n_nationkey % 12 = 1 THEN 90 ELSE 0 END AS days
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 3),
sc AS (SELECT DISTINCT l_partkey AS srt, '992' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS code
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
lists AS (SELECT srt, COUNT(*) AS n_codes, string_agg(code || ':' || grp || ':' || days, '|' ORDER BY code) AS codes
          FROM sc JOIN bc USING (code) GROUP BY srt)"""


@query("srt_context_nested", f"""WITH {CONTEXT_SQL}
SELECT p_partkey AS srt_id, p_name AS srt_name, CASE WHEN p_size % 6 = 0 THEN '22' ELSE '11' END AS pos_code,
       p_size > 25 AS is_specialist, COALESCE(n_codes, 0) AS n_codes, COALESCE(codes, '') AS codes
FROM part LEFT JOIN lists ON srt = p_partkey WHERE p_partkey % 29 <> 0""")
def srt_context_nested(t):
    """J5, A9."""
    ctx = r.srt_context(b.srt(t), b.srt_codes(t), b.billing_codes(t))
    text = F.transform("billing_codes", lambda c: F.concat_ws(":", c["code"], c["code_group"], c["global_days"].cast("string")))
    return ctx.select("srt_id", "srt_name", "pos_code", "is_specialist", F.size("billing_codes").alias("n_codes"),
                      F.array_join(text, "|").alias("codes"))


@query("history_routed", ledger_sql("patientid").replace("JOIN star s ON", "JOIN star s ON r.patientid % 3 <> 0 AND")
       + f""", {MEMBER_FACTS_SQL},
canon AS (SELECT r.request_id, COUNT(*) AS n, SUM(pnr) AS amt FROM requests r JOIN facts f ON f.member_id = r.member_id
          AND {LOOKBACK_SQL.format(d='f.dos')} WHERE r.patientid % 3 = 0 AND r.member_id % 30 <> 0 GROUP BY 1),
led AS (SELECT rid AS request_id, COUNT(*) AS n, SUM(allowable) AS amt FROM topn GROUP BY 1),
src AS (SELECT request_id, CASE WHEN patientid % 3 <> 0 THEN 'ledger' WHEN member_id % 30 <> 0 THEN 'canonical' ELSE 'skipped' END AS s
        FROM requests)
SELECT src.request_id, s AS history_source, COALESCE(led.n, canon.n, 0) AS n_rows, CAST(COALESCE(led.amt, canon.amt) AS DOUBLE) AS amount,
       CASE WHEN s = 'skipped' THEN 'history left out: neither patient nor member is named'
            WHEN COALESCE(led.n, canon.n, 0) > 0 THEN CASE s WHEN 'ledger' THEN 'ledger' ELSE 'member' END || ' history of ' || COALESCE(led.n, canon.n) || ' lines'
            WHEN s = 'ledger' THEN 'the ledger has nothing earlier for this patient' ELSE 'nothing earlier is on file for this member' END AS note
FROM src LEFT JOIN led USING (request_id) LEFT JOIN canon USING (request_id)""")
def history_routed(t):
    """Patient-keyed ledger, else member-keyed claims, else none. Both in whole."""
    from ..operators import asof as a

    reqs = r.route_history(
        b.requests(t).withColumn("ehr_patient_id", F.when(F.col("patientid") % 3 != 0, F.col("patientid")))
        .withColumn("member_id", F.when(F.col("member_id") % 30 != 0, F.col("member_id"))))
    scope = ["org_id", "patientid"]
    by_patient = reqs.where(F.col("history_source") == "ledger").select("request_id", *scope, "asof")
    probes = a.distinct_asof(by_patient, scope, "asof")
    states = lg.line_states(lg.asked_part(b.ledger_star(t), probes, scope, "asof"), scope)
    ledger = a.visible_sums(probes, states, scope, "asof", "claimservicedate", {"amount": F.col("allowable")})
    by_member = reqs.where(F.col("history_source") == "canonical").select("request_id", "member_id", "asof")
    claims = a.visible_sums(a.distinct_asof(by_member, ["member_id"], "asof"), a.event_states(b.canonical_claims(t), "date_of_service"),
                            ["member_id"], "asof", "date_of_service", {"amount": F.col("pnr")})
    shown = lambda df: df.select("request_id", "n_rows", F.col("amount").cast("double").alias("amount"))
    sums = shown(by_patient.join(ledger, [*scope, "asof"])).unionByName(shown(by_member.join(claims, ["member_id", "asof"])))
    out = reqs.select("request_id", "history_source").join(sums, "request_id", "left")
    return (out.withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
            .select("request_id", "history_source", "n_rows", "amount", r.history_note().alias("note")))
