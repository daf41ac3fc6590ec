from decimal import Decimal

from pyspark.sql import functions as F

from priorview.operators import eligibility as e
from priorview.operators import jsonsearch
from priorview.operators import results as rs
from priorview.operators import scorecard as s
from priorview.schemas import LATER_COLUMNS, RESULT_COLUMNS, as_result_rows
from priorview.sources import eligibility as se
from priorview.sources import requests as rq
from priorview.sources import tables as tb

BENEFIT = ("eligibilitytrackid int, contextid string, benefitinfo string, coveragelevel string, timeperiodtype string, "
           "servicetypecode string, plannetwork string, monetaryamount string, plancoveragedesc string")


def test_accumulator_ladder_and_filters(spark):
    rows = [(1, "c", "C", "IND", "22", "30", "Y", "100.5", None), (1, "c", "C", "IND", "23", "30", "Y", "99.4", "plan b"),
            (2, "c", "C", "FAM", "22", "30", "Y", "7", "plan a"), (2, "c", "C", "FAM", "29", "30", None, "5", "plan z"),
            (2, "c", "C", "FAM", "24", "30", "N", "5", None), (2, "c", "G", "FAM", "24", "98", "Y", "5", None), (2, "c", "G", "FAM", "24", "30", "Y", "abc", None)]
    df = spark.createDataFrame(rows, BENEFIT)
    got = {x.eligibilitytrackid: x for x in e.accumulators(df).collect()}
    assert (got[1].ind_deductible_total, got[2].fam_deductible_total) == (99, 7)
    assert got[2].fam_deductible_remaining is None and got[2].fam_oop_max_met is None
    cents = {x.eligibilitytrackid: x for x in e.accumulators(df, scale=2).collect()}
    assert cents[1].ind_deductible_total == Decimal("99.40")
    assert {x.plancoveragedesc for x in e.plan_descriptions(df).collect()} == {"plan b", "plan z"}


def test_forwarded_own_and_gate(spark):
    reqs = spark.createDataFrame(
        [(1, "", '[{"stc":98,"response":{"benefitsInformation":[]}},{"stc":98,"response":{"benefitsInformation":[],"planInformation":{"groupNumber":5}}}]'),
         (2, "R", '{"results":[{"stc":"30","response":{"x":1}}]}'), (3, None, "null"), (4, None, '"text"'), (5, "Q", None)],
        "request_id int, group_number string, j string").withColumn("eligibility", F.parse_json("j"))
    sent = e.forwarded_tiles(reqs)
    assert sorted((x.request_id, x.pos, x.stc) for x in sent.collect()) == [(1, 0, "98"), (1, 1, "98")]
    own = se.classify_responses(spark.createDataFrame(
        [(1, 0, "30", 200, "{}"), (2, 0, "30", 200, '{"subscriber":{"groupNumber":"S"}}'), (3, 0, "30", 200, '{"subscriber":{"groupNumber":"S"}}'),
         (4, 0, "30", 500, '{"m":"' + "x" * 600 + '"}'), (4, 1, "98", 200, '{"errors":[{"c":1}]}')],
        "request_id int, pos int, stc string, http_status int, body string"))
    tiles = e.choose_tiles(sent, own)
    groups = {x.request_id: x.group_number for x in e.group_numbers(reqs, tiles).collect()}
    assert groups == {1: "5", 2: "R", 3: "S", 4: None, 5: "Q"}
    gate = {x.request_id: x for x in e.gate(reqs, tiles).collect()}
    assert [gate[i].gate_open for i in (1, 2, 3, 4, 5)] == [True, True, True, False, False]
    assert gate[4].gate_error.startswith('HTTP 500: {"m":"x') and len(gate[4].gate_error) == 618
    cut = se.classify_responses(spark.createDataFrame([(4, 0, "30", 500, '{"m":"' + "x" * 600 + '"}')],
                                                      "request_id int, pos int, stc string, http_status int, body string"), limit=500).first()
    assert len(cut.error) == 510
    assert gate[5].gate_error == "no tile came back"


def test_only_checks_that_count_are_parsed(spark):
    sent = spark.createDataFrame([(1, 0, "98", None)], "request_id int, pos int, stc string, response string")
    own = spark.createDataFrame([(1, 0, "30", 200, "{}"), (2, 0, "30", 200, "{}"), (None, 0, "30", 500, "{}")],
                                "request_id int, pos int, stc string, http_status int, body string")
    parsed = []

    def classify(rows):
        parsed.extend(x.request_id for x in rows.collect())
        return se.classify_responses(rows)

    tiles = e.choose_tiles(sent.withColumn("response", F.parse_json("response")), own, classify=classify)
    assert set(parsed) == {2, None}
    assert {(x.request_id, x.ok, x.eligibility_source) for x in tiles.collect()} == {
        (1, True, "forwarded"), (2, True, "self"), (None, False, "self")}


def test_request_rules_keep_unknown_keys(spark):
    good = ('{"requestId":"a","x":1,"dto":{"dateOfBirth":"d","serviceDate":"2024-01-02","orgId":1,"zz":[1],'
            '"primaryInsurance":{"memberId":"m","payer":"p"},"hrtToSrts":[{"hrtId":1,"srtIds":[2,2]}]}}')
    bad = good.replace('"srtIds":[2,2]', '"srtIds":[]').replace('"requestId":"a"', '"requestId":""')
    df = spark.createDataFrame([(1, good), (2, bad), (3, "[]"), (4, None)], "k int, body string")
    got = {x.k: x for x in rq.validate(df).collect()}
    assert got[1].reasons == [] and got[2].reasons == ["requestId", "srtIds"] and "dto" in got[3].reasons and got[4].reasons == ["json"]
    valid = rq.accepted(rq.validate(df))
    assert valid.select(F.try_variant_get("raw", "$.dto.zz[0]", "int")).first()[0] == 1
    assert [(x.hrt_id, x.srt_id, x.srt_pos) for x in rq.request_lines(valid).collect()] == [(1, 2, 0), (1, 2, 1)]


def test_token_cost_rounds_half_up_and_defaults(spark):
    rows = [("large", 0, 0, 1), ("nobody", 1_000_000, 0, 0), ("small", 0, 1, 0), (None, 0, 0, 3)]
    df = spark.createDataFrame(rows, "model_id string, input_tokens long, output_tokens long, cache_read_tokens long")
    got = {x.model_id: x.estimated_cost_usd for x in rs.token_cost(df, rs.model_rates(spark)).collect()}
    assert got == {"large": Decimal("0.000001"), "nobody": Decimal("5.000000"), "small": Decimal("0.000005"), None: Decimal("0.000002")}


def test_usage_keeps_a_real_zero(spark):
    df = spark.sql("""SELECT parse_json('{"inputTokens":0,"promptTokens":9,"completionTokens":4}') AS u""")
    assert tuple(df.select(*[c.alias(n) for n, c in rs.normalize_usage(F.col("u")).items()]).first()) == (0, 4, 0)


def test_results_of_all_versions_read_back(spark, tmp_path):
    base = {"request_id": "r1", "status": "ERROR", "confidence": "UNABLE_TO_PRICE"}
    new = as_result_rows(spark.createDataFrame([base]).withColumn("pricing_date", F.lit("2024-01-02").cast("date")))
    old = new.drop(*LATER_COLUMNS).withColumn("request_id", F.lit("r0"))
    path = str(tmp_path / "results")
    old.write.partitionBy("pricing_date").parquet(path)
    tb.append_results(new.withColumn("sampling_stratum", F.lit("s")), path)
    back = tb.read_results(spark, path)
    assert back.columns == [c for c, _ in RESULT_COLUMNS]
    assert {(x.request_id, x.sampling_stratum) for x in back.collect()} == {("r0", None), ("r1", "s")}
    ids = spark.createDataFrame([("r1",)], "request_id string")
    assert tb.lookup_results(back, ids).count() == 1 and tb.lookup_results(back, ids.limit(0)).count() == 0


def test_numeric_ids_are_filtered_and_truncated(spark):
    df = spark.createDataFrame([(1.9,), (float("nan"),), (float("inf"),), (None,), (-2.5,)], "id double")
    assert sorted(x.id for x in tb.keep_numeric_ids(df, "id").collect()) == [-2, 1]


def test_a_run_is_good_or_failed_never_both(spark):
    rows = [("a", "2024-01-02T00", "{}", None), ("b", "soon", "{}", None), ("c", "soon", "{}", "broken"), ("d", "2024-01-02", "{}", "x" * 3000), ("e", None, "{}", None)]
    df = spark.createDataFrame(rows, "request_id string, service_date string, dto_json string, parse_error string")
    for c, k in (("sampling_stratum", "string"), ("inclusion_probability", "double"), ("sampling_reason", "string"), ("caller_request_type", "string")):
        df = df.withColumn(c, F.lit(None).cast(k))
    runs = rs.with_failure(df)
    assert [r.request_id for r in runs.where("failure is null").collect()] == ["a"]
    got = {r.request_id: r for r in rs.error_rows(runs, rs.version_columns(None, None)).collect()}
    assert set(got) == {"b", "c", "d", "e"} and got["b"].error_message == got["c"].error_message
    assert len(got["d"].error_message) == 3000 and got["b"].pricing_date is None and got["b"].pricer_version == "dev" and got["b"].run_id is None
    assert len({r.request_id: r for r in rs.error_rows(runs, {}, limit=2000).collect()}["d"].error_message) == 2000


def test_bundles_are_whole_json_or_drop_whole_entries(spark):
    import json

    reqs = spark.createDataFrame([(1, "x"), (2, "y")], "request_id int, org string")
    part = spark.createDataFrame([(1, k, (k, "v" * 10)) for k in range(50)], "request_id int, pos int, entry struct<k:int,v:string>")
    whole = {r.request_id: r for r in rs.evidence_bundles(reqs, {"own": part}).collect()}
    assert len(json.loads(whole[1].own)) == whole[1].n_own == 50 and whole[1].dropped_own == 0 and whole[2].own is None
    cut = {r.request_id: r for r in rs.evidence_bundles(reqs, {"own": part}, {"own": 200}).collect()}[1]
    kept = json.loads(cut.own)
    assert [e["k"] for e in kept] == list(range(len(kept))) and len(cut.own) <= 200 and cut.dropped_own == 50 - len(kept) > 0


def test_json_search_survives_any_document(spark):
    nested = '{"group":' * 150 + "1" + "}" * 150
    deep = "[" * 100_000 + '{"group":[1, 2]}' + "]" * 100_000
    rows = [(1, nested), (2, '{"\\u0067roup":{"a":[{"GROUPS":[]}]}}'), (3, "no json group"), (4, deep), (5, None), (6, '{"group":1,}'),
            (7, '{"group" : "a\\"b" } '), (8, '{"group":1} x'), (9, "")]
    df = spark.createDataFrame(rows, "id int, j string")
    got = jsonsearch.find_keys(df, "id", "j", "Group").collect()
    assert sum(x.id == 1 for x in got) == 150
    assert {(x.path, x.value) for x in got if x.id == 2} == {("$.group", '{"a":[{"GROUPS":[]}]}'), ("$.group.a[0].GROUPS", "[]")}
    assert [x.value for x in got if x.id == 4] == ["[1, 2]"] and [x.value for x in got if x.id == 7] == ['"a\\"b"']
    bad = {x.id for x in jsonsearch.search_keys(df, "id", "j", "group").where("error is not null").collect()}
    assert bad == {3, 6, 8} and {x.id for x in got} == {1, 2, 4, 7}


def test_unit_weights_equal_the_unweighted_metric_and_rejects_are_counted(spark):
    rows = [("b", 3, 5.0, 10.0, 7.0, 1.0), ("b", 3, 9.0, 8.0, 7.0, None), ("b", 3, 1.0, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "pricer_version string, conf_rank int, estimate double, incumbent_price double, actual double, p double")
    money = [F.col(c).cast("decimal(12,2)").alias(c) for c in ("estimate", "incumbent_price", "actual")]
    df = df.select("pricer_version", "conf_rank", "p", *money)
    df = (df.withColumn("estimate_err", F.col("estimate") - F.col("actual")).withColumn("incumbent_err", F.col("incumbent_price") - F.col("actual"))
          .withColumn("w", s.sampling_weight("p")))
    usable, rejected = s.split_by_weight(df)
    assert (usable.count(), rejected.count()) == (2, 1)
    row = s.scorecard_by_build(df).first()
    assert (row.n_sampled, row.est_population_n, float(row.estimate_wmae), float(row.estimate_bias), float(row.estimate_underprice_rate)) == (2, 2, 2.0, 0.0, 0.5)

def test_parsed_ids_stay_out_of_the_driver(spark):
    from priorview.plans import bindings as b

    t = b.Tables(spark, "/root/testdata/sf0.001")
    plan = b.tiles(t)._jdf.queryExecution().executedPlan().toString()
    anti = [line for line in plan.splitlines() if "LeftAnti" in line and "Join" in line]
    assert anti and all("SortMergeJoin" in line for line in anti)
