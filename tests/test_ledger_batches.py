"""A stored ledger that batches of postings keep up to date."""

from datetime import date
from decimal import Decimal

import pytest

from priorview.operators import ledger as lg
from priorview.sources import commits as cm
from test_ledger import STAR, random_star

SCOPE = ["org_id", "patientid"]


def rows_of(states):
    cols = sorted(c for c in states.columns if c != "service_month")
    return sorted((tuple(map(str, r)) for r in states.select(*cols).collect()))


@pytest.mark.parametrize("options", [{}, {"totals_per_claim": True, "rank_per_claim": True}])
def test_batches_equal_the_states_built_at_once(spark, tmp_path, options):
    rows = random_star(21, 400)
    posted = [date(2023, 3, 1), date(2023, 6, 1)]
    voided = rows[10:400:37]
    parts = [[r for r in rows if r[-1] < posted[0]], [r for r in rows if posted[0] <= r[-1] < posted[1]], [r for r in rows if r[-1] >= posted[1]]]
    path = str(tmp_path / "ledger")
    frame = lambda x: spark.createDataFrame(x, STAR)
    assert lg.apply_postings(frame(parts[0]), path, SCOPE, "a", **options)
    assert rows_of(lg.kept_states(spark, path)) == rows_of(lg.line_states(frame(parts[0]), SCOPE, **options))
    assert lg.apply_postings(frame(parts[2]), path, SCOPE, "b", **options)  # postings need not come in order
    (tmp_path / "ledger" / "daily" / "batch=c").mkdir()                      # what a failed run left behind
    assert lg.apply_postings(frame(parts[1]), path, SCOPE, "c", voided=frame(voided), **options)
    left = list(rows)
    for v in voided:
        left.remove(v)
    assert rows_of(lg.kept_states(spark, path)) == rows_of(lg.line_states(frame(left), SCOPE, **options))
    before = rows_of(lg.kept_states(spark, path))
    assert not lg.apply_postings(frame(parts[1]), path, SCOPE, "c", **options)
    assert rows_of(lg.kept_states(spark, path)) == before


def test_only_touched_months_are_written_and_a_month_may_lose_all(spark, tmp_path):
    path, line = str(tmp_path / "ledger"), lambda k, month, amount: (
        1, "g", "A", k, k, "c", 1, date(2024, month, 1), None, None, None, None, 1, "CHARGE", "Primary", None, Decimal(amount), date(2024, month, 5))
    first = [line(1, 1, 7), line(2, 1, 8), line(1, 2, 9), line(3, 3, 5)]
    lg.apply_postings(spark.createDataFrame(first, STAR), path, SCOPE, "a")
    late = [(*line(1, 1, 100)[:-1], date(2024, 4, 1))]
    lg.apply_postings(spark.createDataFrame(late, STAR), path, SCOPE, "b", voided=spark.createDataFrame([line(3, 3, 5)], STAR))
    records = cm.commits(spark, path)
    assert [r["keys"] for r in records] == [["2024-01-01", "2024-02-01", "2024-03-01"], ["2024-01-01", "2024-03-01 -"]]
    assert sorted(p.name for p in (tmp_path / "ledger" / "states" / "batch=b").glob("service_month=*")) == ["service_month=2024-01-01"]
    states = lg.kept_states(spark, path)
    got = sorted((r.patientid, str(r.claimservicedate), int(r.allowable), str(r.valid_from), str(r.valid_to)) for r in states.collect())
    assert got == [(1, "2024-01-01", 7, "2024-01-06", "2024-04-02"), (1, "2024-01-01", 107, "2024-04-02", "2026-01-02"),
                   (1, "2024-02-01", 9, "2024-02-06", "2026-02-02"), (2, "2024-01-01", 8, "2024-01-06", "2026-01-02")]
    reqs = spark.createDataFrame([(1, 1, 1, date(2024, 5, 1))], "request_id int, org_id int, patientid int, asof date")
    assert [int(r.allowable) for r in lg.ledger_lookup(reqs, states, SCOPE, "asof").orderBy("rank").collect()] == [9, 107]


def test_parts_without_a_record_are_not_seen_and_a_merge_keeps_all(spark, tmp_path):
    path, kind = str(tmp_path / "t"), "k int, d date"
    frame = lambda *ks: spark.createDataFrame([(k, date(2024, 1, k)) for k in ks], kind)
    schema = frame().schema
    assert cm.read(spark, path, schema).count() == 0
    assert cm.append(frame(1, 2), path, "a", "d") and cm.append(frame(3), path, "b", "d")
    frame(9).write.partitionBy("d").parquet(cm.part(path, "torn"))
    assert not cm.append(frame(7), path, "a", "d")
    read = lambda: sorted(r.k for r in cm.read(spark, path, schema).collect())
    assert read() == [1, 2, 3]
    assert cm.merge(spark, path, "m1", schema, "d") and read() == [1, 2, 3]
    assert cm.append(frame(4), path, "torn", "d") and read() == [1, 2, 3, 4]
    assert not cm.merge(spark, path, "m1", schema, "d") and len(cm.live(cm.commits(spark, path))) == 2
    with pytest.raises(ValueError):
        cm.append(frame(1), path, "../x")
