from datetime import datetime, timedelta

import pytest

from priorview.streaming import requests as st

KIND = "request_id string, priced_at timestamp, v int"
T0 = datetime(2024, 1, 1)


def write(spark, path, rows, kind=KIND):
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").json(str(path))


def test_stream_drops_repeats_and_a_replay_adds_nothing(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    schema = spark.createDataFrame([], KIND).schema

    def run():
        posts = st.request_stream(spark, str(src), schema, max_files=1)
        first = st.first_posts(posts, "request_id", "priced_at", "2 days")
        st.start_sink(first, out, state, once=True).awaitTermination()
        return sorted((r.request_id, r.v) for r in spark.read.parquet(out).collect())

    write(spark, src, [("a", T0, 1), ("a", T0, 1), ("b", T0, 2)])
    assert run() == [("a", 1), ("b", 2)]
    write(spark, src, [("a", T0 + timedelta(hours=1), 9), ("c", T0 + timedelta(hours=1), 3)])
    assert run() == [("a", 1), ("b", 2), ("c", 3)]
    assert run() == [("a", 1), ("b", 2), ("c", 3)]


def test_late_outcomes_meet_their_results(spark, tmp_path):
    left, right = tmp_path / "l", tmp_path / "r"
    write(spark, left, [("a", T0, 1), ("b", T0, 2)])
    okind = "request_id string, outcome_at timestamp, paid int"
    write(spark, right, [("a", T0 + timedelta(days=14), 7), ("b", T0 + timedelta(days=40), 8), ("z", T0, 0)], okind)
    res = st.request_stream(spark, str(left), spark.createDataFrame([], KIND).schema)
    got = st.request_stream(spark, str(right), spark.createDataFrame([], okind).schema)
    joined = st.join_late_outcomes(res, got)
    st.start_sink(joined, str(tmp_path / "o"), str(tmp_path / "s"), once=True).awaitTermination()
    assert [(r.request_id, r.paid) for r in spark.read.schema(joined.schema).parquet(str(tmp_path / "o")).collect()] == [("a", 7)]


def test_rescore_takes_the_latest_outcome_of_open_requests(spark):
    results = spark.createDataFrame([("a",), ("b",), ("c",)], "request_id string")
    outcomes = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 30)], "request_id string, outcome_at int, paid int")
    scored = spark.createDataFrame([("b",)], "request_id string")
    got = st.rescore_open(results, outcomes, scored).collect()
    assert [(r.request_id, r.paid) for r in got] == [("a", 20)]


def test_stream_and_batch_fill_one_table(spark, tmp_path, monkeypatch):
    src, table, state = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "state")
    schema = spark.createDataFrame([], KIND).schema

    def run():
        posts = st.request_stream(spark, str(src), schema, max_files=1)
        st.start_table(posts, table, state, "feed", once=True).awaitTermination()

    def rows():
        return sorted((str(r.request_id), r.v) for r in st.read_new(spark, table, schema).collect())

    write(spark, src, [("a", T0, 1), ("a", T0, 1), ("b", T0, 2)])
    run()
    assert rows() == [("a", 1), ("b", 2)]
    assert st.append_new(spark.createDataFrame([("b", T0, 9), ("c", T0, 3), (None, T0, 0), (None, T0, 0)], KIND), table, "job-1")
    assert not st.append_new(spark.createDataFrame([("z", T0, 9)], KIND), table, "job-1")
    write(spark, src, [("a", T0 + timedelta(days=40), 8), ("c", T0 + timedelta(days=40), 8), ("d", T0, 4)])

    whole = st.cm.append

    def torn(frame, path, batch, partition):
        frame.limit(1).write.mode("overwrite").partitionBy(partition).parquet(st.cm.part(path, batch))
        raise RuntimeError("lost between the files and the record")

    monkeypatch.setattr(st.cm, "append", torn)
    with pytest.raises(Exception):
        run()
    monkeypatch.setattr(st.cm, "append", whole)
    assert ("d", 4) not in rows()
    run()  # the same micro-batch again
    run()
    assert rows() == [("None", 0), ("None", 0), ("a", 1), ("b", 2), ("c", 3), ("d", 4)]
