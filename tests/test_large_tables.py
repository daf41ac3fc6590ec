"""What only larger tables show: limits that bind, and tables that look small to the planner."""

from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from oracle import TABLES, compare, duck
from priorview.operators import ledger as lg
from priorview.operators import sliding as sl
from priorview.plans import bindings as b
from priorview.plans import estimate_queries, registry
from test_ledger import STAR, random_star

SF = "/root/testdata/sf0.001"


@pytest.fixture
def busy_member(tmp_path):
    """One member with 500 claims in 500 days; the early ones cost far more."""
    for name in TABLES:
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    n = 500
    rows = {"o_orderkey": list(range(n)), "o_custkey": [1] * n, "o_orderstatus": ["F"] * n,
            "o_totalprice": [900000.0 if i < 100 else 1000.0 + i for i in range(n)],
            "o_orderdate": [datetime(1995, 1, 1) + timedelta(days=i) for i in range(n)], "o_orderpriority": ["1-URGENT"] * n}
    (tmp_path / "orders.parquet").unlink()
    pq.write_table(pa.table(rows, pq.read_schema(f"{SF}/orders.parquet")), tmp_path / "orders.parquet")
    return str(tmp_path)


def test_own_outcomes_count_every_claim(spark, busy_member):
    con = duck(busy_member)
    for name in ("confidence_caps", "estimate_cost_share"):
        assert compare(registry.QUERIES[name](spark, busy_member), con, registry.ORACLES[name]) == ""


def test_states_are_not_sent_through_the_driver(spark, tmp_path):
    spark.sql("SELECT 1 AS k, DATE'2023-01-01' AS valid_from, DATE'2023-09-01' AS valid_to, 1.0D AS v").write.parquet(f"{tmp_path}/states")
    spark.sql("SELECT 1 AS k, DATE'2023-02-01' AS at").write.parquet(f"{tmp_path}/probes")
    states, probes = spark.read.parquet(f"{tmp_path}/states"), spark.read.parquet(f"{tmp_path}/probes")
    found = sl.visible_median(probes, states, ["k"], "at", "v")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert [r.median for r in found.collect()] == [1.0]
    lines = b._lines_with_customer(b.Tables(spark, SF))
    assert "SortMergeJoin" in lines._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def crowded_days(tmp_path):
    """Requests of one organisation's groups that come on few days, so that many share group and day."""
    for name in TABLES:
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    late = pq.read_table(f"{SF}/orders.parquet").to_pandas()
    late["o_orderdate"] = late["o_orderdate"].where(late["o_orderdate"] < datetime(1996, 1, 1), datetime(1996, 6, 1))
    (tmp_path / "orders.parquet").unlink()
    pq.write_table(pa.Table.from_pandas(late, pq.read_schema(f"{SF}/orders.parquet"), preserve_index=False), tmp_path / "orders.parquet")
    return str(tmp_path)


def test_requests_of_a_group_and_day_share_one_list(spark, crowded_days, monkeypatch):
    listed, bundles = [], estimate_queries.rs.evidence_bundles

    def watched(requests, parts, **options):
        listed.extend(part.select("request_id").distinct().count() for name, part in parts.items() if name == "grp")
        return bundles(requests, parts, **options)

    monkeypatch.setattr(estimate_queries.rs, "evidence_bundles", watched)
    found = registry.QUERIES["evidence_bundle"](spark, crowded_days)
    assert compare(found, duck(crowded_days), registry.ORACLES["evidence_bundle"]) == ""
    assert 0 < listed[0] < found.where("n_grp > 0").count() / 2


def test_peers_of_all_lines_are_counted_not_paired(spark):
    plan = registry.QUERIES["peer_distribution_all"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan


def test_a_delivery_is_not_one_task(spark, monkeypatch):
    frame, plain = type(spark.range(1)), type(spark.range(1)).coalesce

    def watched(self, n):
        assert "request_id" not in self.columns, "a delivery goes through one task"
        return plain(self, n)

    monkeypatch.setattr(frame, "coalesce", watched)
    assert registry.QUERIES["result_feed"](spark, SF).count() > 0


def test_states_come_without_a_table_of_daily_rows(spark):
    star = b.ledger_star(b.Tables(spark, SF))
    plan = lg.line_states(star, ["org_id", "patientid"])._jdf.queryExecution().optimizedPlan().toString()
    sums = [line for line in plan.splitlines() if "Aggregate [" in line and "posted_on" in line]
    assert len(sums) == 1, "only the first day of a claim line is an aggregate of postings"


def test_a_history_with_eligibility_is_worked_out_once(spark):
    plan = registry.QUERIES["ledger_with_eligibility"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "posted_on" not in plan


def test_a_batch_meets_its_cells_in_one_join(spark, tmp_path, monkeypatch):
    worked, states_of = [], lg.states_of
    monkeypatch.setattr(lg, "states_of", lambda daily, *more: worked.append(daily) or states_of(daily, *more))
    star = spark.createDataFrame(random_star(3), STAR)
    for batch, rows in (("a", F.col("claimid") % 2 == 0), ("b", F.col("claimid") % 2 == 1)):
        lg.apply_postings(star.where(rows), str(tmp_path / "ledger"), ["org_id", "patientid"], batch)
    joins = [frame._jdf.queryExecution().optimizedPlan().toString().count("Join ") for frame in worked]
    assert joins == [0, 1]


def test_a_claim_is_found_before_codes_multiply_its_lines(spark):
    plan = registry.QUERIES["scorecard_line_level"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = lambda key: next(i for i, line in enumerate(plan) if f"Join Inner, ({key}#" in line)
    assert at("srt_id") < at("request_id"), "the join on request_id is the inner one"


@pytest.mark.parametrize("name", ["group_history_topn", "group_ledger_with_eligibility", "peer_distribution"])
def test_newest_lines_of_a_group_are_sought_month_by_month(spark, monkeypatch, name):
    seen, topn = [], lg.asof_topn
    monkeypatch.setattr(lg, "asof_topn", lambda *args: seen.append(args[-1]) or topn(*args))
    registry.QUERIES[name](spark, SF)
    assert seen == [1]
