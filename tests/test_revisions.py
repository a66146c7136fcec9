"""Changes of several tables: a stale read fails whichever table is written; what moves, moves in all of them."""

import pytest

from tidewell.operators import revisions as V


def tables(spark):
    roles = spark.createDataFrame([(1, 7, "merged", "internship", "internship", True, None), (2, 7, "other", "unknown", "other", True, None), (3, 8, "gone", "new_grad", "new_grad", True, None)], "role_id int, company_id int, title string, level string, track string, active boolean, superseded_by int")
    matches = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (3, 12)], "role_id int, observation_id int")
    aliases = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "role_id int, first_observation_id int")
    followers = spark.createDataFrame([(1, "a"), (3, "b"), (3, "c")], "role_id int, user string")
    return {"roles": roles, "matches": matches, "aliases": aliases, "events": matches, "followers": followers}


SPLITS = [(1, 101, "program", "new_grad", "kept", None), (3, 103, "moved", "full_time", None, None)]
SPLIT = "source int, target int, title string, level string, source_title string, source_level string"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_a_split_moves_in_all_tables(spark):
    splits, moves = spark.createDataFrame(SPLITS, SPLIT), spark.createDataFrame([(1, 11), (3, 12)], "source int, observation_id int")
    out = V.split_roles(splits, moves, **tables(spark))
    assert rows(out["matches"], "role_id", "observation_id") == [(1, 10), (101, 11), (103, 12), (2, 10)] == rows(out["events"], "role_id", "observation_id")
    assert rows(out["aliases"], "role_id", "first_observation_id") == [(1, 10), (101, 11), (2, 10)] and rows(out["followers"], "role_id", "user") == [(1, "a"), (103, "b"), (103, "c")]
    assert rows(out["roles"], "role_id", "company_id", "title", "level", "track", "active", "superseded_by") == sorted(
        [(1, 7, "kept", "internship", "internship", True, None), (2, 7, "other", "unknown", "other", True, None), (3, 8, "gone", "new_grad", "new_grad", False, 103), (101, 7, "program", "new_grad", "new_grad", True, None), (103, 8, "moved", "full_time", "other", True, None)], key=repr
    )
    assert rows(out["audit"], "source", "target", "observations", "retired", "aliases", "events", "followers") == [(1, 101, 1, False, 1, 1, 0), (3, 103, 1, True, 0, 1, 2)]


@pytest.mark.parametrize("table", ["roles", "matches", "aliases", "events", "followers", "audit"])
def test_a_stale_split_fails_in_every_table(spark, table):
    splits, moves = spark.createDataFrame(SPLITS, SPLIT), spark.createDataFrame([(1, 11), (1, 12), (3, 12)], "source int, observation_id int")
    with pytest.raises(Exception, match="observation 12 no longer belongs to role 1"):
        V.split_roles(splits, moves, **tables(spark))[table].collect()


def test_reviews_compare_and_set(spark):
    roles = spark.createDataFrame([(1, "ambiguous", "x", None, None, "deterministic", 5), (2, "in_scope", "in_scope", "data", "internship", "human_review", 6), (3, "out_of_scope", "y", None, None, "deterministic", 7)], "role_id int, status string, reason string, discipline string, type string, method string, classified_at int")
    kind = "review_id int, role_id int, listed_at int, status string, reason string, discipline string, type string, decided_at int"
    ok = [(50, 1, 5, "in_scope", "in_scope", "design", "co_op", 9), (51, 2, 6, "out_of_scope", "not_a_role", None, None, 9)]
    after, added = V.review_scopes(roles, spark.createDataFrame(ok, kind))
    assert rows(after, "role_id", "status", "discipline", "method", "classified_at") == [(1, "in_scope", "design", "human_review", 9), (2, "out_of_scope", None, "human_review", 9), (3, "out_of_scope", None, "deterministic", 7)]
    assert rows(added, "review_id", "role_id") == [(50, 1), (51, 2)]
    for stale in ((52, 1, 4, "in_scope", "in_scope", "design", "co_op", 9), (53, 3, 7, "in_scope", "in_scope", "design", "co_op", 9), (54, 4, 7, "in_scope", "in_scope", "design", "co_op", 9)):
        for table in V.review_scopes(roles, spark.createDataFrame([stale], kind)) if stale[1] != 4 else V.review_scopes(roles, spark.createDataFrame([stale], kind))[1:]:
            with pytest.raises(Exception, match="changed since it was listed"):
                table.collect()
