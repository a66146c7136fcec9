"""The followed timeline: points, places, ties and stale forecasts by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewell.operators import timeline as T

DAY = dt.date(2026, 3, 1)


def after(n):
    return DAY + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def tables(spark):
    roles = spark.createDataFrame(
        [(1, 10, "software", "internship", "summer", "New York, NY", "large"), (2, 10, "data", "new_grad", "fall", "Remote", "small"), (3, 11, "software", "new_grad", "fall", "York", "small"), (4, 12, None, None, None, None, None), (5, 12, "quant", "other", "fall", "", "small")],
        "role_id bigint, company_id bigint, family string, level string, season string, location string, size string",
    )
    follows = spark.createDataFrame([(1, "role", "1"), (1, "role", "1"), (1, "company", "10"), (1, "family", "software"), (1, "track", "new_grad"), (2, "company", "12"), (2, "company", None), (3, "role", "99"), (4, "company", "10")], "user_id bigint, kind string, target string")
    prefs = spark.createDataFrame(
        [(1, [(10, 5), (10, 2), (11, 9)], ["software"], ["summer"], ["new york", ""], ["large"], 2027), (2, None, None, None, None, None, None)],
        "user_id bigint, priority_companies array<struct<company_id:bigint,level:int>>, families array<string>, seasons array<string>, places array<string>, sizes array<string>, graduation_year int",
    )
    forecasts = spark.createDataFrame([(1, after(-7), after(20), after(5)), (2, after(0), after(20), None), (3, after(-8), after(1), None), (4, after(-1), after(-3), None), (5, after(-1), None, after(-4))], "role_id bigint, forecast_as_of date, expected_on date, due_on date")
    return roles, follows, prefs, forecasts, F.lit(DAY)


def test_points_reasons_and_places(tables):
    rows = {(r["user_id"], r["role_id"]): r for r in T.timeline(*tables).collect()}
    first = rows[1, 1]
    assert {x["reason"]: x["points"] for x in first["rank_reasons"]} == {"follow": 40, "priority_company": 20, "family": 10, "season": 8, "location": 8, "size": 6, "graduation": 8, "milestone": 25}
    assert first["rank_score"] == 125 and first["place"] == 1 and first["followed_by"] == ["company", "family", "role"] and first["next_on"] == after(5)
    second = rows[1, 2]  # 20 days are two whole weeks
    assert {x["reason"]: x["points"] for x in second["rank_reasons"]} == {"follow": 25, "priority_company": 20, "graduation": 8, "opening": 10}
    assert (1, 3) not in rows  # eight days old
    assert rows[2, 5]["rank_score"] == 55 and rows[2, 5]["place"] == 1  # overdue
    assert rows[2, 4]["rank_score"] == 25 and rows[2, 4]["place"] == 2  # opened before
    assert rows[4, 2]["rank_score"] == 35  # a user without preferences
    assert {u for u, _ in rows} == {1, 2, 4}


def test_excluded_and_pages(tables):
    roles, follows, prefs, forecasts, as_of = tables
    assert {r["user_id"]: (r["excluded_stale"], r["followed"]) for r in T.excluded(roles, follows, forecasts, as_of).collect()} == {1: (1, 3), 2: (0, 2), 4: (0, 2)}
    assert [(r["user_id"], r["role_id"]) for r in T.timeline(*tables, size=1).orderBy("user_id").collect()] == [(1, 1), (2, 5), (4, 1)]
    assert T.timeline(roles.limit(0), follows, prefs, forecasts, as_of).count() == 0


def test_places_match_in_both_directions(spark):
    rows = [("New York, NY", ["york"], True), ("York", ["New York"], True), ("Yorkshire", ["york"], False), ("", ["x"], False), ("x", ["", None], False), (None, ["x"], False), ("x", None, False), ("São Paulo", ["são paulo brazil"], True)]
    df = spark.createDataFrame(rows, "location string, wanted array<string>, want boolean")
    for r in df.withColumn("got", T.place_matches(F.col("wanted"), F.col("location"))).collect():
        assert r["got"] == r["want"], r


def test_ties_go_by_date_then_role(spark, tables):
    roles = spark.createDataFrame([(i, 1, "f", "other", "fall", "x", "small") for i in (3, 1, 2)], tables[0].schema)
    follows = spark.createDataFrame([(1, "family", "f")], tables[1].schema)
    forecasts = spark.createDataFrame([(3, DAY, after(200), None), (1, DAY, after(300), None), (2, DAY, after(300), None)], tables[3].schema)
    assert [r["role_id"] for r in T.timeline(roles, follows, tables[2].limit(0), forecasts, tables[4]).orderBy("place").collect()] == [3, 1, 2]
