import random
from datetime import date, timedelta
from decimal import Decimal

import duckdb
from pyspark.sql import functions as F

from priorview.operators import ledger as lg

STAR = ("org_id int, group_number string, procedurecode string, patientid int, claimid int, context_id string, "
        "claimappointmentid int, claimservicedate date, primary_memberid string, primary_package string, "
        "secondary_memberid string, secondary_package string, patientinsuranceid int, transactiontype string, "
        "transactiontransfertype string, transactionreason string, amount decimal(12,2), posted_on date")


def random_star(seed, n=500):
    """Few keys and dates, so that claims collide on every key; NULLs in all nullable ones."""
    rnd = random.Random(seed)
    maybe = lambda v, p=0.15: None if rnd.random() < p else v
    claims = {}
    for claim in range(60):
        patient = 1 if rnd.random() < 0.4 else rnd.randrange(2, 6)
        ins = maybe(patient * 10 + rnd.randrange(2))
        claims[claim] = (patient, maybe(rnd.randrange(2)), date(2023, 1, 1) + timedelta(days=40 * rnd.randrange(6)), ins)
    rows = []
    for _ in range(n):
        claim = rnd.randrange(60)
        patient, appt, dos, ins = claims[claim]
        kind = rnd.choice([("CHARGE", "Primary", None), ("ADJUSTMENT", "Primary", None), ("PAYMENT", "Primary", None),
                           ("PAYMENT", "Secondary", None), ("TRANSFERIN", "Patient", "DEDUCT"), ("TRANSFEROUT", "Patient", "DEDUCTIBLE"),
                           ("TRANSFERIN", "Patient", "COPAY"), ("TRANSFERIN", "Patient", "COINSURANCE"), ("TRANSFERIN", "Patient", None)]
                          + ([("TRANSFERIN", "Patient", "OTHER")] if rnd.random() < 0.1 else []))
        rows.append((1, None if ins is None else f"g{ins % 2}", maybe(rnd.choice("AB")), patient, claim, "c", appt, dos,
                     None if ins is None else f"m{ins}", "p", None, None, ins, *kind,
                     maybe(Decimal(rnd.randrange(-500, 2000)), 0.05), dos + timedelta(days=rnd.randrange(-5, 60))))
    return rows


def reference_rows(con, scope, n):
    from priorview.plans.history_queries import ledger_sql

    sql = ledger_sql(scope, n)
    start = sql.index("seen AS")
    return con.execute("WITH " + sql[start:] + " SELECT rid, rank, total_rows, code, claimid, dos, pins, deduct, coins, copay, allowable, payment FROM topn").fetchall()


def test_states_equal_the_definition(spark):
    for seed, scope_key, n in ((1, "patientid", None), (2, "group_number", None), (3, "patientid", 3)):
        rows = random_star(seed)
        rnd = random.Random(seed)
        reqs = [(i, 1, rnd.randrange(1, 6), f"g{rnd.randrange(2)}", date(2023, 1, 1) + timedelta(days=rnd.randrange(900))) for i in range(60)]
        star = spark.createDataFrame(rows, STAR)
        rdf = spark.createDataFrame(reqs, "request_id int, org_id int, patientid int, group_number string, asof date")
        con = duckdb.connect()
        con.register("star_src", star.toPandas())
        con.register("req_src", rdf.toPandas())
        con.execute("CREATE TABLE requests AS SELECT request_id, org_id, patientid, group_number, CAST(req_src.asof AS DATE) AS \"asof\" FROM req_src")
        con.execute("""CREATE TABLE star AS SELECT org_id, group_number, procedurecode AS code, patientid, claimid, context_id AS contextid,
            CAST(claimappointmentid AS INTEGER) AS appt, CAST(claimservicedate AS DATE) AS dos, primary_memberid AS m1, primary_package AS k1,
            CAST(NULL AS VARCHAR) AS m2, CAST(NULL AS VARCHAR) AS k2, CAST(patientinsuranceid AS INTEGER) AS pins, transactiontype AS ttype,
            transactiontransfertype AS tto, transactionreason AS why, CAST(amount AS DECIMAL(12,2)) AS amount, CAST(posted_on AS DATE) AS posted FROM star_src""")
        want = {tuple(map(str, r)) for r in reference_rows(con, scope_key, n)}
        found = lg.ledger_history(rdf, star, ["org_id", scope_key], "asof", n=n)
        got = rdf.select("request_id", "org_id", scope_key, "asof").join(found, ["org_id", scope_key, "asof"]).select(
            "request_id", "rank", "total_rows", "procedurecode", "claimid", "claimservicedate", "patientinsuranceid",
            "deduct", "coins", "copay", "allowable", "payment")
        assert len(want) > 20
        assert {tuple(map(str, r)) for r in got.collect()} == want


def test_per_claim_options_keep_every_claim(spark):
    star = spark.createDataFrame(random_star(5), STAR)
    shared = lg.line_states(star, ["org_id", "patientid"])
    own = lg.line_states(star, ["org_id", "patientid"], totals_per_claim=True, rank_per_claim=True)
    assert own.select("claimid").distinct().count() >= shared.select("claimid").distinct().count()


def test_pivot_of_no_posting_is_null_and_null_reason_counts_nowhere(spark):
    base = (1, None, "A", 1, 1, "c", 1, date(2024, 1, 1), None, None, None, None, 1)
    rows = [(*base, "TRANSFERIN", "Patient", None, Decimal(5), date(2024, 1, 2)), (*base, "CHARGE", "Primary", None, Decimal(7), date(2024, 1, 2))]
    r = lg.cost_share_pivot(spark.createDataFrame(rows, STAR), ["claimid"]).first()
    assert (r.allowable, r.other, r.copay, r.payment) == (7, None, None, None)


def test_whole_ledger_of_a_patient_with_many_lines_and_stored_states(spark, tmp_path):
    day = date(2023, 1, 1)
    base = lambda k: (1, "g", f"C{k}", 1, k, "c", 1, day + timedelta(days=k % 300), None, None, None, None, 1)
    rows = [(*base(k), "CHARGE", "Primary", None, Decimal(7), day + timedelta(days=k % 300 + 1)) for k in range(950)]
    star = spark.createDataFrame(rows, STAR)
    reqs = spark.createDataFrame([(1, 1, 1, date(2024, 1, 1)), (2, 1, 1, date(2023, 2, 1))], "request_id int, org_id int, patientid int, asof date")
    scope = ["org_id", "patientid"]
    found = lg.ledger_history(reqs, star, scope, "asof").collect()
    assert len([r for r in found if r.asof == date(2024, 1, 1)]) == 950
    assert {r.total_rows for r in found if r.asof == date(2024, 1, 1)} == {950}
    lg.build_line_states(star, scope, str(tmp_path / "states"))
    again = lg.ledger_lookup(reqs, spark.read.parquet(str(tmp_path / "states")), scope, "asof").collect()
    key = lambda r: (r.asof, r["rank"], r.claimid, r.allowable)
    assert sorted(map(key, again)) == sorted(map(key, found))


def test_asking_for_a_history_starts_no_job(spark):
    star = spark.createDataFrame(random_star(6), STAR)
    reqs = spark.createDataFrame([(1, 1, 1, date(2024, 1, 1))], "request_id int, org_id int, patientid int, asof date")
    spark.sparkContext.setJobGroup("lazy", "no job")
    lg.ledger_history(reqs, star, ["org_id", "patientid"], "asof")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_states_read_the_ledger_once(spark, tmp_path):
    spark.createDataFrame(random_star(7), STAR).write.parquet(str(tmp_path / "star"))
    star = spark.read.parquet(str(tmp_path / "star"))
    states = lg.line_states(star, ["org_id", "patientid"])
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan
    assert states.count() > 20


def test_dense_groups_make_the_pairs_of_their_newest_lines_only(spark):
    scope, n = ["org_id", "group_number"], 3
    rnd = random.Random(4)
    reqs = spark.createDataFrame([(i, 1, f"g{rnd.randrange(2)}", date(2023, 1, 1) + timedelta(days=rnd.randrange(900))) for i in range(60)],
                                 "request_id int, org_id int, group_number string, asof date")
    states = lg.line_states(spark.createDataFrame(random_star(4), STAR), scope).localCheckpoint()
    probes = lg.distinct_asof(reqs, scope, "asof")
    want = lg.asked_lines(probes, states, scope, "asof", n)
    got = lg.dense_lines(probes, states, scope, "asof", n).select(*want.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    pairs = lg.dense_lines(probes, states, scope, "asof", n, ranked=False)
    assert pairs.count() == want.count() > 50
