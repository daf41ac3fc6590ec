from datetime import date

import pytest
from pyspark.sql import functions as F

from priorview import functions as fn


def values(spark, kind, rows, expr):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", expr(F.col("x"))).orderBy("i").collect()]


def test_npi_known_cases(spark):
    rows = ["LETTERS123", "1234567893", " 1234567893 ", "123456789", "12345678901", "12345ABC90", "", None]
    assert values(spark, "string", rows, fn.valid_npi) == [None, "1234567893", "1234567893"] + [None] * 5


def test_date_prefix_ignores_the_rest_and_rejects_bad_text(spark):
    rows = ["2024-02-29T23:30:00-08:00", "2024-13-01", "on 2024-01-01", None, "2024-1-1"]
    assert values(spark, "string", rows, fn.date_prefix) == [date(2024, 2, 29), None, None, None, None]


def test_try_number_rounds_cents_away_by_default(spark):
    rows = ["1234.56", "2.5", "-2.5", "", "abc", None]
    assert [None if v is None else int(v) for v in values(spark, "string", rows, fn.try_number)] == [1235, 3, -3, None, None, None]
    assert str(values(spark, "string", ["1234.56"], lambda c: fn.try_number(c, 2))[0]) == "1234.56"


def test_csv_and_containment(spark):
    assert values(spark, "string", [" 007, ,12,\t3 ", "", None], fn.split_csv) == [["007", "12", "3"], [], []]
    assert values(spark, "string", ["50% Plan", "50x Plan"], lambda c: fn.contains_ci(c, F.lit("0% p"))) == [True, False]


@pytest.mark.parametrize("asof,event,inside", [
    (date(2026, 2, 28), date(2024, 2, 28), True), (date(2026, 2, 28), date(2024, 2, 27), False),
    (date(2024, 2, 29), date(2022, 2, 28), True), (date(2024, 2, 29), date(2022, 2, 27), False),
    (date(2024, 3, 1), date(2022, 2, 28), False), (date(2025, 5, 5), date(2025, 5, 5), False),
    (date(2025, 5, 5), date(2025, 5, 4), True)])
def test_asof_guard_and_lookback_boundaries(spark, asof, event, inside):
    df = spark.createDataFrame([(asof, event)], "asof date, event date")
    got = df.select(fn.as_of(["event"], "asof") & fn.within_lookback("event", "asof")).first()[0]
    assert got is inside
    last = df.select(fn.last_asof_date("event", 24)).first()[0]
    assert (event < asof <= last) is inside


def test_weight_of_missing_zero_and_fractional_probability(spark):
    got = values(spark, "double", [None, 0.0, 0.25, 1.0], fn.sampling_weight)
    assert [None if w is None else float(w) for w in got] == [1.0, None, 4.0, 1.0]
