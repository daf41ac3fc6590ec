import random
from datetime import date, datetime, timedelta

from dateutil.relativedelta import relativedelta
from pyspark.sql import functions as F

from priorview.operators import asof as a
from priorview.operators import eligibility as e

DAY0 = date(2020, 1, 1)


def brute_history(requests, facts, n):
    out = set()
    for rid, key, asof in requests:
        low = asof - relativedelta(months=24)
        seen = sorted(((d, i) for i, k, d in facts if k == key and low <= d < asof), key=lambda x: (x[0], x[1]), reverse=True)
        out |= {(rid, rank + 1, fid, len(seen)) for rank, (_, fid) in enumerate(seen[:n])}
    return out


def history_case(seed):
    """One key holds a third of the facts and of the requests, many of them on one day."""
    rnd = random.Random(seed)
    key = lambda: "hot" if rnd.random() < 0.34 else f"k{rnd.randrange(40)}"
    when = lambda: DAY0 + timedelta(days=500 if rnd.random() < 0.1 else rnd.randrange(1500))
    facts = [(i, key(), when()) for i in range(1500)]
    requests = [(i, key(), when()) for i in range(400)]
    return requests, facts


def test_history_equals_brute_force_with_a_hot_key(spark):
    for seed, n in ((1, 5), (2, 40)):
        requests, facts = history_case(seed)
        want = brute_history(requests, facts, n)
        for shuffled in (facts, facts[::-1]):
            got = a.asof_history(spark.createDataFrame(requests, "request_id int, key string, asof date"),
                                 spark.createDataFrame(shuffled, "fact int, key string, day date"),
                                 ["key"], "asof", "day", [F.col("fact").desc()], n=n)
            assert {(r.request_id, r["rank"], r.fact, r.total_rows) for r in got.collect()} == want


def test_no_history_row_is_dated_on_or_after_the_asof_date(spark):
    requests, facts = history_case(3)
    got = a.asof_history(spark.createDataFrame(requests, "request_id int, key string, asof date"),
                         spark.createDataFrame(facts, "fact int, key string, day date"),
                         ["key"], "asof", "day", [F.col("fact").desc()], n=400)
    assert got.where(F.col("day") >= F.col("asof")).count() == 0


def test_null_keys_see_nothing(spark):
    reqs = spark.createDataFrame([(1, None, date(2021, 1, 1))], "request_id int, key string, asof date")
    facts = spark.createDataFrame([(1, None, date(2020, 12, 1))], "fact int, key string, day date")
    assert a.asof_history(reqs, facts, ["key"], "asof", "day", [F.col("fact").desc()]).count() == 0


def test_latest_by_null_order_is_explicit(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", 5), (2, "c", 1), (2, "d", 1)], "k int, v string, at int")
    last = {r.k: r.v for r in a.latest_by(df, ["k"], "at", ["v"]).collect()}
    first = {r.k: r.v for r in a.latest_by(df, ["k"], "at", ["v"], nulls="first").collect()}
    assert last == {1: "b", 2: "d"} and first == {1: "a", 2: "d"}


def test_latest_track_equals_brute_force(spark):
    rnd = random.Random(7)
    base = datetime(2024, 1, 1)
    tracks, lines = [], []
    for i in range(500):
        ins = 1 if rnd.random() < 0.34 else rnd.randrange(2, 9)
        serves = base + timedelta(days=rnd.randrange(60))
        created = serves + timedelta(days=rnd.randrange(-3, 40), hours=rnd.randrange(24))
        note = "<b class=successtext>x" if rnd.random() < 0.9 else "<b class=error>"
        tracks.append(("c", ins, i, serves.isoformat(), created, note, None if rnd.random() < 0.05 else "x"))
    for i in range(200):
        ins = None if i % 20 == 0 else (1 if rnd.random() < 0.34 else rnd.randrange(2, 9))
        day = (base + timedelta(days=rnd.randrange(90))).date()
        lines.append((i, "c", ins, day, day + timedelta(days=rnd.randrange(1, 50))))
    tdf = spark.createDataFrame(tracks, "contextid string, patientinsuranceid int, eligibilitytrackid int, "
                                        "dateofservicedatetime string, createddatetime timestamp, verificationnote string, incomingtransaction string")
    ldf = spark.createDataFrame(lines, "line int, contextid string, patientinsuranceid int, day date, asof date")
    for strict in (False, True):
        want = {}
        for line, _, ins, day, asof in lines:
            limit = datetime.combine(day + timedelta(days=30), datetime.min.time())
            bar = datetime.combine(asof, datetime.min.time()) if strict else limit
            ok = [(t[4], t[2]) for t in tracks if t[1] == ins and t[3][:10] <= day.isoformat() and t[4] < limit
                  and t[4] < bar and t[5].startswith("<b class=successtext") and t[6]]
            want[line] = max(ok)[1] if ok else None
        got = e.latest_track(ldf, tdf, "day", asof="asof" if strict else None)
        assert {r.line: r.eligibilitytrackid for r in got.collect()} == want
