"""Every named query against its SQL on the smallest tables, and a look at every plan."""

import pytest

import __spark_entry__ as entry
from oracle import compare, duck
from priorview.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) == ""
    else:
        assert df.count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_limited_query_has_a_whole_form(spark):
    for name in ("peer_distribution", "peer_tiers", "estimate_from_evidence", "evidence_bundle", "payer_candidates", "payer_first_ok"):
        assert ORACLES[f"{name}_all"] != ORACLES[name] and "row_no <= 5" not in ORACLES[f"{name}_all"] and "rank <= " not in ORACLES[f"{name}_all"]
    longest = [max(len(r.candidates) for r in QUERIES[n](spark, SF).collect()) for n in ("payer_candidates", "payer_candidates_all")]
    assert longest[0] < longest[1]


def test_outcomes_of_all_lines(spark):
    got = QUERIES["late_outcome_stream_all"](spark, SF).collect()
    assert len(got) > QUERIES["late_outcome_stream"](spark, SF).count()
    assert len(got) > len({r.request_id for r in got})
