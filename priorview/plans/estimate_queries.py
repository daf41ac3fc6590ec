"""Estimate, evidence, JSON search and streaming."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import computed_once, short_digest
from ..operators import eligibility as e
from ..operators import estimate as es
from ..operators import jsonsearch
from ..operators import ledger as lg
from ..operators import resolve as r
from ..operators import results as rs
from ..operators import stc_rules as st
from ..operators.asof import distinct_asof
from ..schemas import as_result_rows
from ..session import scratch_dir, stored
from ..sources import requests as rq
from ..streaming import requests as stream
from . import bindings as b
from .catalog import ORACLES, query
from .history_queries import GROUP_SCOPE, LOOKBACK_SQL, MEMBER_FACTS_SQL, REQUESTS_SQL, asked_states, ledger_sql, member_history
from .request_queries import K_SQL, TILES_FLAT_SQL, TILES_SQL
from .resolve_queries import CONTEXT_SQL, LINES_SQL, chains
from .scorecard_queries import as_double

def _group_ledger(t, reqs, n=None, ranked=True):
    if n is None:
        return lg.ledger_history(reqs, b.ledger_star(t), GROUP_SCOPE, "asof")
    return lg.dense_lines(distinct_asof(reqs, GROUP_SCOPE, "asof"), stored(asked_states(t, reqs, GROUP_SCOPE), "states"), GROUP_SCOPE, "asof", n, ranked, stored)


def _group_peers(t, reqs, n=None):
    """The stored states of the groups, each request's newest ``n`` lines or all."""
    states = lg.newest_lines(reqs, stored(asked_states(t, reqs, GROUP_SCOPE), "states"), GROUP_SCOPE, "asof", n)
    return states if n is None else stored(states, "newest")


def _whole(name):
    """The SQL of a limited query without its limits."""
    sql = ORACLES[name]
    for limited, whole in ((ledger_sql("group_number", 200), ledger_sql("group_number")), ("FROM h WHERE rank <= 400 GROUP", "FROM h GROUP")):
        sql = sql.replace(limited, whole)
    return sql


@query("peer_distribution", ledger_sql("group_number", 200) + """,
c AS (SELECT *, COALESCE(copay, 0) + COALESCE(coins, 0) + COALESCE(deduct, 0) AS cost FROM topn),
modes AS (SELECT rid, code, copay, ROW_NUMBER() OVER (PARTITION BY rid, code ORDER BY COUNT(*) DESC, copay) AS rn
          FROM c WHERE copay IS NOT NULL GROUP BY rid, code, copay),
s AS (SELECT rid, code, COUNT(*) AS n_lines, median(CAST(allowable AS DOUBLE)) AS median_allowable,
             AVG(CASE WHEN cost = 0 THEN 1.0 ELSE 0.0 END) AS zero_share FROM c GROUP BY rid, code)
SELECT s.rid AS request_id, s.code AS procedurecode, n_lines, median_allowable, CAST(m.copay AS DOUBLE) AS copay_mode, zero_share,
       zero_share BETWEEN 0.25 AND 0.75 AS is_split
FROM s LEFT JOIN modes m ON m.rid = s.rid AND m.code IS NOT DISTINCT FROM s.code AND m.rn = 1""")
def peer_distribution(t, n=200):
    """What the group's lines of each code cost, as of each request: its newest ``n`` lines."""
    reqs = b.requests(t).select("request_id", *GROUP_SCOPE, "asof")
    peers = es.peer_distribution(_group_ledger(t, reqs, n, ranked=False), [*GROUP_SCOPE, "asof"])
    return reqs.join(peers, [*GROUP_SCOPE, "asof"]).drop(*GROUP_SCOPE, "asof")


@query("peer_tiers", ledger_sql("group_number", 200) + """,
ln AS (SELECT request_id AS rid, CASE request_id % 3 WHEN 0 THEN 'P' || (request_id % 5) WHEN 1 THEN 'P9' ELSE 'Q1' END AS code FROM requests),
t1 AS (SELECT rid, code, median(CAST(allowable AS DOUBLE)) AS m FROM topn GROUP BY 1, 2),
t2 AS (SELECT rid, left(code, 1) AS fam, median(CAST(allowable AS DOUBLE)) AS m FROM topn GROUP BY 1, 2),
t3 AS (SELECT rid, median(CAST(allowable AS DOUBLE)) AS m FROM topn GROUP BY 1)
SELECT ln.rid AS request_id, ln.code AS procedurecode, COALESCE(t1.m, t2.m, t3.m) AS peer_median,
       CASE WHEN t1.m IS NOT NULL THEN 1 WHEN t2.m IS NOT NULL THEN 2 WHEN t3.m IS NOT NULL THEN 3 END AS peer_tier
FROM ln LEFT JOIN t1 ON t1.rid = ln.rid AND t1.code = ln.code LEFT JOIN t2 ON t2.rid = ln.rid AND t2.fam = left(ln.code, 1)
LEFT JOIN t3 ON t3.rid = ln.rid""")
def peer_tiers(t, n=200):
    """Exact code, then its family, then any code, of the group's newest ``n`` lines."""
    k = F.col("request_id")
    code = F.when(k % 3 == 0, F.concat(F.lit("P"), k % 5)).when(k % 3 == 1, "P9").otherwise("Q1")
    reqs = b.requests(t).select("request_id", *GROUP_SCOPE, "asof").withColumn("procedurecode", code)
    out = es.tiered_allowable_asof(reqs, _group_peers(t, reqs, n), GROUP_SCOPE, "asof", family_length=1)
    return out.drop(*GROUP_SCOPE, "asof", "peer_split")


@query("benefit_class", f"""WITH {CONTEXT_SQL},
c AS (SELECT p_partkey AS srt, COALESCE(CASE p_size % 5 WHEN 1 THEN '2' WHEN 2 THEN '98' WHEN 3 THEN 'MH' WHEN 4 THEN '5' END, '30') AS prim,
        p_size % 6 = 0 AS fac FROM part WHERE p_partkey % 29 <> 0),
k AS (SELECT c.srt, prim, fac, COUNT(bc.code) AS n, COUNT(*) FILTER (WHERE bc.code BETWEEN '99202' AND '99215') AS office,
        COALESCE(BOOL_OR(grp = 'Surgery' OR days > 0), FALSE) AS sc FROM c LEFT JOIN sc ON sc.srt = c.srt LEFT JOIN bc ON bc.code = sc.code GROUP BY 1, 2, 3)
SELECT srt AS srt_id, prim = '2' OR fac OR sc AS is_surgical, n AS n_codes,
       CASE WHEN prim = '2' OR fac OR sc THEN n - office ELSE n END AS n_usable FROM k""")
def benefit_class(t):
    """Surgical lines may not lean on office-visit codes."""
    srt = b.srt(t)
    ctx = (r.srt_context(srt, b.srt_codes(t), b.billing_codes(t))
           .join(st.default_chains(srt).withColumnRenamed("default_primary", "primary"), "srt_id")
           .withColumn("is_surgical", es.is_surgical()))
    codes = ctx.select("srt_id", "is_surgical", F.explode_outer("billing_codes.code").alias("code"))
    return codes.groupBy("srt_id", "is_surgical").agg(
        F.count("code").alias("n_codes"),
        F.count_if(F.col("code").isNotNull() & es.usable_evidence("code", "is_surgical")).alias("n_usable"))


@query("primary_tile_check", f"""WITH {TILES_SQL},
l AS (SELECT request_id, CASE k % 3 WHEN 0 THEN '30' WHEN 1 THEN '98' ELSE '7' END AS prim FROM ev)
SELECT l.request_id, prim AS "primary", EXISTS (SELECT 1 FROM tiles t WHERE t.request_id = l.request_id AND t.stc = prim AND t.ok) AS has_primary_tile
FROM l""")
def primary_tile_check(t):
    """D19."""
    k = F.get_json_object("props", "$.k").cast("int")
    lines = t.events.select(F.col("event_id").alias("request_id"),
                            F.when(k % 3 == 0, "30").when(k % 3 == 1, "98").otherwise("7").alias("primary"))
    return es.primary_tile_state(lines, b.tiles(t))


@query("code_glossary", f"""WITH {LINES_SQL},
each AS (SELECT UNNEST(list_concat([prim], secs)) AS stc FROM per_srt),
g(stc, meaning) AS (VALUES ('1', 'Medical Care'), ('2', 'Surgical'), ('5', 'Diagnostic Lab'), ('7', 'Anesthesia'),
  ('30', 'Health Benefit Plan Coverage'), ('62', 'MRI/CAT Scan'), ('69', 'Maternity'), ('96', 'Professional (Physician) Visit'),
  ('98', 'Professional Visit - Office'), ('MH', 'Mental Health'), ('UC', 'Urgent Care'), ('A4', 'Psychiatric'), ('A6', 'Psychotherapy'),
  ('BU', 'OB-related'), ('BV', 'OB-related'))
SELECT stc, COUNT(*) AS n_uses, meaning, meaning IS NOT NULL AS is_defined FROM each LEFT JOIN g USING (stc) GROUP BY stc, meaning""")
def code_glossary(t):
    """The service types in use, with their meaning or a flag."""
    codes = chains(t).select(F.explode(F.concat(F.array("primary"), "secondaries")).alias("stc"))
    meaning, defined = es.stc_meaning("stc")
    return (codes.groupBy("stc").agg(F.count(F.lit(1)).alias("n_uses"))
            .withColumn("meaning", meaning).withColumn("is_defined", defined))


OWN_SQL = f"""{REQUESTS_SQL}, {MEMBER_FACTS_SQL},
own AS (SELECT r.request_id, COUNT(*) AS n, MAX(v) AS mx, MIN(v) AS mn, AVG(CAST(v AS DOUBLE)) AS mean
  FROM requests r JOIN (SELECT *, CASE WHEN member_id % 9 = 0 THEN 0 ELSE ROUND(pnr * CAST(0.001 AS DECIMAL(4,3)), 2) END AS v FROM facts) f
  ON f.member_id = r.member_id AND {LOOKBACK_SQL.format(d='f.dos')} GROUP BY 1),
ev AS (SELECT o_orderkey AS k, ROUND(CAST(o_totalprice AS DECIMAL(12,2)) * CAST(0.001 AS DECIMAL(4,3)), 2) AS amt FROM orders),
e0 AS (SELECT k AS request_id, CASE WHEN k % 4 = 0 THEN 20 + k % 5 END AS copay, CASE WHEN k % 3 = 0 THEN 25 END AS mode, k % 8 = 0 AS differs,
  CASE k % 4 WHEN 1 THEN CAST(0.2 AS DECIMAL(5,4)) WHEN 2 THEN CAST(0.1 AS DECIMAL(5,4)) ELSE 0 END AS pct,
  CASE WHEN k % 3 = 0 THEN amt WHEN k % 5 = 0 THEN amt + 1 WHEN k % 7 = 0 THEN amt + 2 WHEN k % 10 <> 1 THEN amt + 3 END AS allowable,
  CASE WHEN k % 3 = 0 THEN 'group median' WHEN k % 5 = 0 THEN 'own claim' WHEN k % 7 = 0 THEN 'eligibility rate' WHEN k % 10 <> 1 THEN 'MARKET ESTIMATE' END AS source,
  CASE WHEN k % 6 = 0 THEN 10 WHEN k % 6 = 1 THEN 20 ELSE CASE WHEN k % 2 = 0 THEN 30 END END AS ded,
  CASE WHEN k % 9 = 0 THEN 50 END AS oop FROM ev),
e1 AS (SELECT e0.*, LEAST(allowable, COALESCE(ded, 0)) AS d, COALESCE(n >= 2 AND mx = 0 AND mn = 0, FALSE) AS az, COALESCE(n >= 2 AND mx = mn, FALSE) AS same, mx, own.mean FROM e0 LEFT JOIN own USING (request_id)),
e2 AS (SELECT *, pct * (allowable - d) AS coi,
  CASE WHEN copay IS NOT NULL THEN CASE WHEN differs THEN COALESCE(mode, copay) ELSE copay END ELSE d + pct * (allowable - d) END AS owed FROM e1),
e25 AS (SELECT *, CASE WHEN owed IS NOT NULL THEN ROUND(GREATEST(LEAST(owed, COALESCE(oop, owed)), 0), 2) END AS rule FROM e2),
e3 AS (SELECT *, CASE WHEN same THEN ROUND(mx, 2) ELSE rule END AS est,
  CASE WHEN copay IS NOT NULL THEN 'COPAY' WHEN allowable IS NULL THEN NULL WHEN d > 0 AND coi > 0 THEN 'MIXED' WHEN d > 0 THEN 'DEDUCTIBLE' ELSE 'COINSURANCE' END AS kind FROM e25)"""


def _estimated(t):
    k = F.col("o_orderkey")
    dec = lambda c: c.cast("decimal(12,2)")
    none = F.lit(None).cast("decimal(12,2)")
    amt = dec(F.round(b.money("o_totalprice") * F.lit("0.001").cast("decimal(4,3)"), 2))
    evidence = t.orders.select(
        k.alias("request_id"), F.when(k % 4 == 0, dec(k % 5 + 20)).alias("copay"),
        F.when(k % 3 == 0, dec(F.lit(25))).alias("copay_mode"), (k % 8 == 0).alias("copay_differs"),
        F.when(k % 4 == 1, F.lit("0.2").cast("decimal(5,4)")).when(k % 4 == 2, F.lit("0.1").cast("decimal(5,4)")).alias("coins_pct"),
        F.when(k % 3 == 0, amt).alias("peer_median"), F.when(k % 5 == 0, dec(amt + 1)).alias("own_allowable"),
        F.when(k % 7 == 0, dec(amt + 2)).alias("tile_rate"), F.when(k % 10 != 1, dec(amt + 3)).alias("market_allowable"),
        F.when(k % 6 == 0, dec(F.lit(10))).alias("spend"), F.when(k % 6 <= 1, dec(F.lit(20))).alias("spend_override"),
        F.when(k % 2 == 0, dec(F.lit(30))).alias("tile_remaining"), F.when(k % 9 == 0, dec(F.lit(50))).otherwise(none).alias("oop_remaining"),
        (k % 3 + 1).cast("int").alias("base_rank"), (k % 5 == 2).alias("is_split"), (k % 12 != 5).alias("has_primary_tile"))
    pnr = F.when(F.col("member_id") % 9 == 0, none).otherwise(dec(F.round(F.col("pnr") * F.lit("0.001").cast("decimal(4,3)"), 2)))
    history = member_history(t, None).withColumn("pnr", F.coalesce(pnr, F.lit(0).cast("decimal(12,2)")))
    own = es.own_outcomes(history, ["request_id"])
    with_own = evidence.join(own, "request_id", "left").withColumn(
        "deductible_remaining", es.remaining_amount("spend", "spend_override", "tile_remaining"))
    return es.estimate_cost_share(es.choose_allowable(with_own))


@query("estimate_cost_share", f"""WITH {OWN_SQL}
SELECT request_id, CAST(est AS DOUBLE) AS estimate, kind AS benefit_type, source AS allowable_source, az AS own_always_zero FROM e3""")
def estimate_cost_share(t):
    """D20, D21, D22, D24."""
    out = _estimated(t).select("request_id", "estimate", "benefit_type", "allowable_source",
                               F.coalesce("own_always_zero", F.lit(False)).alias("own_always_zero"))
    return as_double(out, "estimate")


@query("confidence_caps", f"""WITH {OWN_SQL},
g AS (SELECT *, request_id AS k, COALESCE(NOT az AND ABS(mean - rule) > 5 AND ABS(mean - rule) > 0.25 * ABS(rule), FALSE) AS dif FROM e3)
SELECT request_id, dif AS own_differs, CAST(CASE WHEN k % 12 <> 5 THEN est END AS DOUBLE) AS estimate, CASE WHEN est IS NULL OR k % 12 = 5 THEN 0 ELSE
  LEAST(k % 3 + 1, CASE WHEN dif THEN 1 ELSE 3 END, CASE WHEN source = 'MARKET ESTIMATE' AND kind <> 'COPAY' THEN 2 ELSE 3 END,
        CASE WHEN k % 5 = 2 THEN 2 ELSE 3 END) END AS conf_rank FROM g""")
def confidence_caps(t):
    """D19, D23."""
    return as_double(es.cap_confidence(_estimated(t)).select("request_id", "own_differs", "conf_rank", "estimate"), "estimate")


@query("estimate_from_evidence", ledger_sql("group_number", 200) + f""", {MEMBER_FACTS_SQL}, {TILES_SQL}, {LINES_SQL}, {CONTEXT_SQL},
flat AS ({TILES_FLAT_SQL}),
bt AS (SELECT request_id, stc, MAX(CAST(amount AS DECIMAL(12,2))) FILTER (WHERE code = 'B') AS copay, MAX(percent) FILTER (WHERE code = 'A') AS pct,
         MAX(CAST(amount AS DECIMAL(12,2))) FILTER (WHERE code = 'C') AS ded FROM flat GROUP BY 1, 2),
good AS (SELECT DISTINCT request_id, stc FROM tiles WHERE ok),
surg AS (SELECT sc.srt, BOOL_OR(grp = 'Surgery' OR days > 0) AS sc FROM sc JOIN bc USING (code) GROUP BY 1),
l AS (SELECT c.request_id, c.srt, 'P' || (c.srt % 5) AS code, c.prim, c.srt % 29 <> 0 AND
        (c.prim = '2' OR p.p_size % 6 = 0 OR COALESCE(surg.sc, FALSE)) OR c.srt % 29 = 0 AND c.prim = '2' AS surgical
      FROM per_srt c JOIN part p ON p.p_partkey = c.srt LEFT JOIN surg ON surg.srt = c.srt),
cents AS (SELECT rid, code, allowable, CASE WHEN COALESCE(copay, 0) + COALESCE(coins, 0) + COALESCE(deduct, 0) = 0 THEN 1.0 ELSE 0.0 END AS z FROM topn),
t1 AS (SELECT rid, code, median(CAST(allowable AS DOUBLE)) AS m, AVG(z) AS z FROM cents GROUP BY 1, 2),
t2 AS (SELECT rid, left(code, 1) AS fam, median(CAST(allowable AS DOUBLE)) AS m, AVG(z) AS z FROM cents GROUP BY 1, 2),
t3 AS (SELECT rid, median(CAST(allowable AS DOUBLE)) AS m, AVG(z) AS z FROM cents GROUP BY 1),
mine AS (SELECT r.request_id, 'P' || (f.claim_ref % 5) AS code, COUNT(*) AS n, MAX(v) AS mx, MIN(v) AS mn, AVG(CAST(v AS DOUBLE)) AS mean
  FROM requests r JOIN (SELECT *, CASE WHEN member_id % 9 = 0 THEN 0 ELSE ROUND(pnr * CAST(0.001 AS DECIMAL(4,3)), 2) END AS v FROM facts) f
  ON f.member_id = r.member_id AND {LOOKBACK_SQL.format(d='f.dos')} GROUP BY 1, 2),
x0 AS (SELECT l.*, bt.copay, COALESCE(bt.pct, 0) AS pct, COALESCE(bt.ded, 0) AS ded, good.stc IS NOT NULL AS has_tile, mine.n, mine.mx, mine.mn, mine.mean,
    CAST(FLOOR(COALESCE(t1.m, t2.m, t3.m) * 100 + 0.001) / 100 AS DECIMAL(12,2)) AS allowable,
    COALESCE(CASE WHEN t1.m IS NOT NULL THEN t1.z WHEN t2.m IS NOT NULL THEN t2.z ELSE t3.z END BETWEEN 0.25 AND 0.75, FALSE) AS split
  FROM l LEFT JOIN bt ON bt.request_id = l.request_id AND bt.stc = l.prim LEFT JOIN good ON good.request_id = l.request_id AND good.stc = l.prim
  LEFT JOIN t1 ON t1.rid = l.request_id AND t1.code = l.code LEFT JOIN t2 ON t2.rid = l.request_id AND t2.fam = left(l.code, 1)
  LEFT JOIN t3 ON t3.rid = l.request_id LEFT JOIN mine ON mine.request_id = l.request_id AND mine.code = l.code),
x1 AS (SELECT *, CASE WHEN allowable IS NOT NULL THEN LEAST(allowable, ded) END AS d, COALESCE(n >= 2 AND mx = mn, FALSE) AS same FROM x0),
x15 AS (SELECT *, COALESCE(copay, d + CAST(pct AS DECIMAL(9,4)) * (allowable - d)) AS owed FROM x1),
x2 AS (SELECT *, CASE WHEN owed IS NOT NULL THEN ROUND(GREATEST(owed, 0), 2) END AS rule FROM x15),
x3 AS (SELECT *, CASE WHEN same THEN mx ELSE rule END AS est, COALESCE(NOT (same AND mx = 0) AND ABS(mean - CAST(rule AS DOUBLE)) > 5
    AND ABS(mean - CAST(rule AS DOUBLE)) > 0.25 * ABS(CAST(rule AS DOUBLE)), FALSE) AS dif FROM x2)
SELECT request_id, srt AS srt_id, surgical AS is_surgical, has_tile AS has_primary_tile, CAST(CASE WHEN has_tile THEN est END AS DOUBLE) AS estimate,
  CASE WHEN est IS NULL OR NOT has_tile THEN 0 WHEN dif THEN 1 WHEN split THEN 2 ELSE 3 END AS conf_rank FROM x3""")
def estimate_from_evidence(t, n=200):
    """D18-D24 from real evidence: the line's chain, procedure context and tile, the group's ledger
    without codes of the wrong class, and the member's own outcomes of the same code. Of the group, its newest ``n`` lines."""
    ctx = r.srt_context(b.srt(t), b.srt_codes(t), b.billing_codes(t)).select("srt_id", "pos_code", "billing_codes")
    lines = (chains(t).select("request_id", "srt_id", "primary").join(ctx, "srt_id", "left")
             .withColumn("billing_codes", F.coalesce("billing_codes", F.array().cast(ctx.schema["billing_codes"].dataType)))
             .withColumn("is_surgical", es.is_surgical()).drop("pos_code", "billing_codes")
             .withColumn("procedurecode", F.concat(F.lit("P"), F.col("srt_id") % 5)))
    reqs = b.requests(t).select("request_id", *GROUP_SCOPE, "asof")
    # Peers of surgical and of other lines, each without the codes that say nothing about them.
    classes = F.explode(F.array(F.lit(False), F.lit(True)))
    peers = _group_peers(t, reqs, n).withColumn("is_surgical", classes).where(es.usable_evidence("procedurecode", "is_surgical"))
    lines = es.tiered_allowable_asof(lines.join(reqs, "request_id"), peers, [*GROUP_SCOPE, "is_surgical"], "asof", family_length=1).drop(*GROUP_SCOPE, "asof")
    cents = (F.floor(F.col("peer_median") * 100 + 0.001) / 100).cast("decimal(12,2)")
    cell = lambda code, value: F.max(F.when(F.col("code") == code, F.col(value)))
    terms = e.tile_benefits(b.tiles(t)).groupBy("request_id", F.col("stc").alias("primary")).agg(
        cell("B", "amount").alias("copay"), cell("A", "percent").alias("coins_pct"), cell("C", "amount").alias("tile_remaining"))
    none = F.lit(None).cast("decimal(12,2)")
    pnr = F.when(F.col("member_id") % 9 == 0, F.lit(0).cast("decimal(12,2)")).otherwise(
        F.round(F.col("pnr") * F.lit("0.001").cast("decimal(4,3)"), 2).cast("decimal(12,2)"))
    history = member_history(t, None).withColumns({"pnr": pnr, "procedurecode": F.concat(F.lit("P"), F.col("claim_ref") % 5)})
    own = es.own_outcomes(history, ["request_id", "procedurecode"])
    joined = (es.primary_tile_state(lines, b.tiles(t)).join(terms, ["request_id", "primary"], "left")
              .join(own, ["request_id", "procedurecode"], "left")
              .withColumns({"peer_median": cents, "own_allowable": none, "tile_rate": none, "market_allowable": none, "copay_mode": none,
                            "copay_differs": F.lit(False), "oop_remaining": none, "spend": none, "spend_override": none,
                            "base_rank": F.lit(es.HIGH), "is_split": F.coalesce("peer_split", F.lit(False))})
              .withColumn("deductible_remaining", es.remaining_amount("spend", "spend_override", "tile_remaining")))
    out = es.cap_confidence(es.estimate_cost_share(es.choose_allowable(joined)))
    return as_double(out.select("request_id", "srt_id", "is_surgical", "has_primary_tile", "estimate", "conf_rank"), "estimate")


@query("dto_digest", "SELECT doc_id, left(sha256(text), 16) AS digest FROM documents")
def dto_digest(t):
    """D27 digest over whole texts."""
    return t.documents.select("doc_id", short_digest("text").alias("digest"))


@query("deid_sample", """
SELECT o_custkey AS member_id, sample_no, 'orders' AS source_system, o_orderpriority AS procedure_code, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date_of_service,
       CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS pnr
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS sample_no FROM orders)
WHERE sample_no <= 5""")
def deid_sample(t):
    """F12."""
    rows = t.orders.select(F.col("o_custkey").alias("member_id"), "o_orderkey", "o_orderdate", F.lit("orders").alias("source_system"),
                           F.col("o_orderpriority").alias("procedure_code"), F.lit(None).cast("string").alias("modifier"),
                           F.col("o_orderdate").cast("date").cast("string").alias("date_of_service"),
                           b.money("o_totalprice").alias("pnr"), F.lit(None).cast("decimal(12,2)").alias("payment"),
                           F.lit(None).cast("string").alias("payer_plan_name"))
    out = rs.deidentified(rows, ["member_id"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], n=5)
    return as_double(out.drop("modifier", "payment", "payer_plan_name"), "pnr")


@query("evidence_bundle", ledger_sql("group_number", 200) + f""", {MEMBER_FACTS_SQL}, {TILES_SQL}, {LINES_SQL},
h AS (SELECT r.request_id, f.*, ROW_NUMBER() OVER (PARTITION BY r.request_id ORDER BY dos DESC, claim_ref DESC) AS rank
      FROM requests r JOIN facts f ON f.member_id = r.member_id AND {LOOKBACK_SQL.format(d='f.dos')}),
o AS (SELECT request_id, COUNT(*) AS n, '[' || string_agg('{{"claim_ref":' || claim_ref || ',"pnr":' || pnr || '}}', ',' ORDER BY rank) || ']' AS j
      FROM h WHERE rank <= 400 GROUP BY 1),
g AS (SELECT rid AS request_id, COUNT(*) AS n, '[' || string_agg('{{"claimid":' || claimid || ',"allowable":' || allowable || '}}', ',' ORDER BY rank) || ']' AS j
      FROM topn GROUP BY 1),
tl AS (SELECT request_id, COUNT(*) AS n, '[' || string_agg('{{"stc":"' || stc || '","eligibility_source":"' || eligibility_source || '"}}', ',' ORDER BY pos) || ']' AS j
      FROM tiles WHERE ok GROUP BY 1),
li AS (SELECT c.request_id, COUNT(*) AS n, '[' || string_agg('{{"srt_id":' || c.srt || CASE WHEN c.srt % 29 <> 0 THEN ',"srt_name":"' || p.p_name || '"' ELSE '' END
        || ',"primary":"' || prim || '","secondaries":["' || array_to_string(secs, '","') || '"]}}', ',' ORDER BY c.srt) || ']' AS j
      FROM per_srt c JOIN part p ON p.p_partkey = c.srt GROUP BY 1)
SELECT r.request_id, '{{"org_id":' || org_id || ',"asof":"' || r.asof || '"}}' AS header, o.n AS n_own, left(sha256(o.j), 16) AS own_digest,
       g.n AS n_grp, left(sha256(g.j), 16) AS grp_digest, tl.j AS tiles, li.n AS n_lines, left(sha256(replace(li.j, '[""]', '[]')), 16) AS lines_digest
FROM requests r LEFT JOIN o USING (request_id) LEFT JOIN g USING (request_id) LEFT JOIN tl USING (request_id) LEFT JOIN li USING (request_id)""")
def evidence_bundle(t, n=200):
    """What a request is priced from: its lines with names and service-type chains, its
    good tiles, its member's newest claims and its group's newest ``n`` ledger lines. Whole JSON. Without ``n``, all claims and lines."""
    reqs = b.requests(t)
    own = member_history(t, n and 400).select("request_id", F.col("rank").alias("pos"), F.struct("claim_ref", "pnr").alias("entry"))
    # Requests of one group and day are priced from the same lines: the first of them leads, and only its list is made.
    led = (reqs.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct(*GROUP_SCOPE, "asof"))).alias("places"))
           .withColumn("lead", F.min("request_id").over(Window.partitionBy("places"))))
    leads = led.where("request_id = lead").select("request_id", "places")
    grp = (leads.select("request_id", F.inline("places")).join(_group_ledger(t, reqs, n), [*GROUP_SCOPE, "asof"])
           .select("request_id", F.col("rank").alias("pos"), F.struct("claimid", "allowable").alias("entry")))
    shared = rs.evidence_bundles(leads, {"grp": grp}).select(F.col("request_id").alias("lead"), "n_grp", short_digest("grp").alias("grp_digest"))
    tiles = b.tiles(t).where("ok").select("request_id", "pos", F.struct("stc", "eligibility_source").alias("entry"))
    lines = chains(t).join(b.srt(t).select("srt_id", "srt_name").hint("merge"), "srt_id", "left").select(
        "request_id", F.col("srt_id").alias("pos"), F.struct("srt_id", "srt_name", "primary", "secondaries").alias("entry"))
    out = rs.evidence_bundles(reqs.select("request_id", "org_id", "asof"), {"tiles": tiles, "own": own, "lines": lines})
    out = out.join(led.select("request_id", "lead"), "request_id", "left").join(shared, "lead", "left")
    return out.select("request_id", "header", "n_own", short_digest("own").alias("own_digest"), "n_grp",
                      "grp_digest", "tiles", "n_lines", short_digest("lines").alias("lines_digest"))


@query("json_key_search", f"""WITH ev AS (SELECT event_id, {K_SQL} AS k, CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR) AS v FROM events)
SELECT event_id AS doc_id, '$.a.groupNumber' AS path, '"G' || k || '"' AS value FROM ev
UNION ALL SELECT event_id, '$.a.list[0].Group', '1' FROM ev
UNION ALL SELECT event_id, '$.a.list[1].x.subgroup', '[1,{{"group":null}}]' FROM ev
UNION ALL SELECT event_id, '$.a.list[1].x.subgroup[1].group', 'null' FROM ev
UNION ALL SELECT event_id, '$.grouping', '"' || v || '"' FROM ev WHERE k % 2 = 0""")
def json_key_search(t):
    """D25."""
    k = F.get_json_object("props", "$.k").cast("int")
    body = F.concat(F.lit('{"a":{"groupNumber":"G'), k, F.lit('","list":[{"Group":1},{"x":{"subgroup":[1,{"group":null}]}}]}'),
                    F.when(k % 2 == 0, F.concat(F.lit(',"grouping":"'), F.col("value").cast("decimal(10,2)").cast("string"), F.lit('"'))).otherwise(""),
                    F.lit("}"))
    return jsonsearch.find_keys(t.events.select(F.col("event_id").alias("doc_id"), body.alias("body")), "doc_id", "body", "group")


@query("json_extract", f"""SELECT event_id, {K_SQL} AS k, event_type || '-' || {K_SQL} AS label FROM events""")
def json_extract(t):
    """Typed fields out of a semi-structured column."""
    v = t.events.withColumn("v", F.parse_json("props"))
    k = F.try_variant_get("v", "$.k", "int")
    return v.select("event_id", k.alias("k"), F.concat_ws("-", "event_type", k).alias("label"))


@query("stream_results", """
SELECT 'r' || o_orderkey AS request_id, CASE WHEN o_orderkey % 12 = 11 THEN 'ERROR' ELSE 'COMPLETED' END AS status,
       CASE WHEN o_orderkey % 12 <> 11 THEN o_custkey % 500 END AS srt_id,
       CASE WHEN o_orderkey % 12 <> 11 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS pricing_date, NULL AS reasons
FROM orders WHERE o_orderkey % 12 IN (0, 10, 11)
UNION ALL SELECT NULL, 'REJECTED', NULL, NULL, CASE o_orderkey % 12 WHEN 1 THEN 'requestId' WHEN 2 THEN 'requestId' WHEN 3 THEN 'dateOfBirth'
    WHEN 4 THEN 'memberId' WHEN 5 THEN 'hrtToSrts' WHEN 6 THEN 'srtIds' WHEN 7 THEN 'inclusionProbability' WHEN 8 THEN 'orgId' ELSE 'json' END
FROM orders, (VALUES (0), (1)) AS v(again) WHERE o_orderkey % 12 NOT IN (0, 10, 11) AND (again = 0 OR o_orderkey % 10 = 0)""")
def stream_results(t):
    """Posts as a stream. Accepted ones are stored once in the result schema, those
    with a bad date as errors; rejected ones go to a table of their own with the reasons. Posts
    carry their posting time, in which repeats come minutes apart, so state is kept for a day."""
    home = scratch_dir(t.spark)
    orders = stream.request_stream(t.spark, t.sf_dir, t.orders.schema, "parquet", pathGlobFilter="orders.parquet")
    k = F.col("o_orderkey")
    posts = orders.withColumn("post", F.explode(F.when(k % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    values = {"k": k, "d": b.day("o_orderdate"), "c": F.col("o_custkey"), "s": F.col("o_custkey") % 500}
    posted = F.timestamp_seconds(F.lit(1_700_000_000) + k % 3600 + F.col("post") * 60)
    posts = computed_once(posts, body=b.request_body(values)).select(posted.alias("posted_at"), "body")
    checked = rq.validate(posts)
    first = stream.first_posts(checked.where("is_valid")
                               .withColumn("request_id", F.try_variant_get("_top.requestId", "$", "string")),
                               "request_id", "posted_at", "1 day")
    runs = rs.with_failure(rq.accepted(first))
    line = F.col("hrt_to_srts")[0]
    good = F.col("failure").isNull()
    rows = as_result_rows(runs.withColumns({
        "run_id": F.col("request_id"), "status": F.when(good, "COMPLETED").otherwise("ERROR"), "error_message": F.col("failure"),
        "hrt_id": F.when(good, line["hrtId"].cast("bigint")), "srt_id": F.when(good, line["srtIds"][0].cast("bigint")),
        "pricing_date": F.col("asof"), "dto_digest": short_digest("dto_json")}))
    bad = rq.rejects(checked).select("posted_at", "body", F.array_join("reasons", ",").alias("reasons"))
    for name, part in (("results", rows), ("rejects", bad)):
        stream.start_sink(part, f"{home}/{name}", f"{home}/state-{name}", once=True).awaitTermination()
    stored = t.spark.read.schema(rows.schema).parquet(f"{home}/results")
    left = t.spark.read.schema(bad.schema).parquet(f"{home}/rejects")
    none = F.lit(None)
    return (stored.select("request_id", "status", "srt_id", F.col("pricing_date").cast("string").alias("pricing_date"),
                          none.cast("string").alias("reasons"))
            .unionAll(left.select(none.cast("string"), F.lit("REJECTED"), none.cast("bigint"), none.cast("string"), "reasons")))


@query("result_feed", """
SELECT 'r' || o_orderkey AS request_id, CASE WHEN o_orderkey % 4 = 3 THEN 'batch' ELSE 'stream' END AS source, CAST(o_custkey % 500 AS BIGINT) AS srt_id,
       CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS pricing_date FROM orders""")
def result_feed(t):
    """One result table, which a stream of three deliveries and a batch job fill. Repeats come
    inside a delivery, in that of a month later and in the batch; each request stays once, as it
    came first. A delivery has as many files as its size asks for, and the stream takes it up whole."""
    home = scratch_dir(t.spark)
    k = F.col("o_orderkey")
    rows = as_result_rows(t.orders.select(
        F.concat(F.lit("r"), k).alias("request_id"), F.lit("stream").alias("run_id"), (F.col("o_custkey") % 500).cast("bigint").alias("srt_id"),
        b.day("o_orderdate").alias("pricing_date"), F.lit("COMPLETED").alias("status"), F.timestamp_seconds(k % 3600).cast("timestamp_ntz").alias("created_at")))
    number = F.substring("request_id", 2, 20).cast("bigint")
    month = F.expr("INTERVAL 30 DAYS")
    for i in range(3):
        part = rows.where(number % 4 == i)
        again = rows.where((number % 4 == i - 1) & (number % 10 == 0)).withColumns({"srt_id": F.lit(-1).cast("bigint"), "created_at": F.col("created_at") + month})
        part.unionByName(part.where(number % 5 == 0)).unionByName(again).repartition("request_id").write.mode("append").parquet(f"{home}/feed")
        feed = stream.request_stream(t.spark, f"{home}/feed", rows.schema, "parquet")
        stream.start_table(feed, f"{home}/results", f"{home}/state", "stream", buckets=8, once=True).awaitTermination()
    late = rows.where((number % 4 == 3) | (number % 7 == 0)).withColumn("run_id", F.lit("batch"))
    for _ in range(2):  # the second run finds its record
        stream.append_new(late, f"{home}/results", "batch-1", buckets=8)
    found = stream.read_new(t.spark, f"{home}/results", rows.schema)
    return found.select("request_id", F.col("run_id").alias("source"), "srt_id", F.col("pricing_date").cast("string").alias("pricing_date"))


@query("late_outcome_join", """
WITH out AS (SELECT l_orderkey AS k, l_shipdate AS seen, l_partkey AS ref, l_suppkey AS sup FROM lineitem JOIN orders ON l_orderkey = o_orderkey
             WHERE l_shipdate >= o_orderdate),
scored AS (SELECT DISTINCT k FROM out WHERE seen < TIMESTAMP '1998-01-01'),
last AS (SELECT k, ref, seen, ROW_NUMBER() OVER (PARTITION BY k ORDER BY seen DESC, ref DESC) AS rn FROM out WHERE seen < TIMESTAMP '1999-01-01')
SELECT o_orderkey AS request_id, ref AS outcome_ref, date_diff('day', CAST(o_orderdate AS DATE), CAST(seen AS DATE)) AS days_waited
FROM orders JOIN last ON k = o_orderkey AND rn = 1 WHERE o_orderkey NOT IN (SELECT k FROM scored)""")
def late_outcome_join(t):
    """M4: requests open at the last run that have an outcome by now."""
    results = t.orders.select(F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("priced_at"))
    outcomes = (t.lineitem.join(results, F.col("l_orderkey") == F.col("request_id"))
                .where(F.col("l_shipdate") >= F.col("priced_at"))
                .select("request_id", F.col("l_shipdate").alias("outcome_at"), F.col("l_partkey").alias("outcome_ref")))
    scored = outcomes.where(F.col("outcome_at") < F.lit("1998-01-01").cast("timestamp"))
    known = outcomes.where(F.col("outcome_at") < F.lit("1999-01-01").cast("timestamp"))
    out = stream.rescore_open(results, known, scored, ties=("outcome_ref",))
    return out.select("request_id", "outcome_ref", F.date_diff(F.col("outcome_at").cast("date"), F.col("priced_at").cast("date")).alias("days_waited"))


@query("late_outcome_stream", """
SELECT o_orderkey AS request_id, l_partkey AS outcome_ref, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days_waited
FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1
WHERE l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 28 DAY""")
def late_outcome_stream(t, first_line=True):
    """M4 as a stream-stream join: outcomes within 28 days of their result row, for which both
    sides' state is kept and no longer. Only outcomes of an order's first line; see
    `late_outcome_stream_all`."""
    home = scratch_dir(t.spark)

    def feed(name, frame):
        return stream.request_stream(t.spark, t.sf_dir, frame.schema, "parquet", pathGlobFilter=f"{name}.parquet")

    results = feed("orders", t.orders).select(F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").cast("timestamp").alias("priced_at"))
    outcomes = feed("lineitem", t.lineitem).where(F.col("l_linenumber") == 1 if first_line else F.lit(True)).select(
        F.col("l_orderkey").alias("request_id"), F.col("l_shipdate").cast("timestamp").alias("outcome_at"), F.col("l_partkey").alias("outcome_ref"))
    joined = stream.join_late_outcomes(results, outcomes)
    stream.start_sink(joined, f"{home}/joined", f"{home}/state", once=True).awaitTermination()
    found = t.spark.read.schema(joined.schema).parquet(f"{home}/joined")
    return found.select("request_id", "outcome_ref", F.date_diff(F.col("outcome_at").cast("date"), F.col("priced_at").cast("date")).alias("days_waited"))


@query("late_outcome_stream_all", """
SELECT o_orderkey AS request_id, l_partkey AS outcome_ref, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days_waited
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 28 DAY""")
def late_outcome_stream_all(t):
    """The same over the outcomes of all lines."""
    return late_outcome_stream(t, first_line=False)


@query("peer_distribution_all", _whole("peer_distribution"))
def peer_distribution_all(t):
    """Over all visible lines of the group, whose number grows with the requests': by counts, as pairs
    of the two would grow with the square of the input."""
    return peer_distribution_by_counts(t)


@query("peer_distribution_by_counts", ORACLES["peer_distribution_all"])
def peer_distribution_by_counts(t):
    """From running counts over the stored states, without pairing requests and lines."""
    reqs = b.requests(t).select("request_id", *GROUP_SCOPE, "asof")
    probes = stored(distinct_asof(reqs, GROUP_SCOPE, "asof"), "probes")
    peers = es.peer_distribution_asof(probes, _group_peers(t, reqs), GROUP_SCOPE, "asof")
    return reqs.join(peers, [*GROUP_SCOPE, "asof"]).drop(*GROUP_SCOPE, "asof")


@query("peer_tiers_all", _whole("peer_tiers"))
def peer_tiers_all(t):
    """Over all visible lines of the group."""
    return peer_tiers(t, None)


@query("estimate_from_evidence_all", _whole("estimate_from_evidence"))
def estimate_from_evidence_all(t):
    """With peers from all visible lines of the group."""
    return estimate_from_evidence(t, None)


@query("evidence_bundle_all", _whole("evidence_bundle"))
def evidence_bundle_all(t):
    """With all claims of the member and all visible lines of the group."""
    return evidence_bundle(t, None)
