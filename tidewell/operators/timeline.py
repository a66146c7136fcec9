"""The timeline of followed roles: a fixed ordinal ranking with its reasons, version 1.

Only roles that a follow covers are ranked. The most specific follow counts; a priority company counts by
its level, the other preferences once each; a milestone's urgency stands before that of the opening.
Forecasts older than seven days are left out and counted. Where the rule names only a bound (urgency), the
points fall by one a day until a milestone and by one a week until an opening.

Defined results: a null list of preferences wants nothing; an empty place matches none; a company listed
twice counts by its higher level; a level outside 1 to 5 by the nearer of them; repeated follows are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points of the ranking and the age of a stale forecast in days.
SCOPES = {"role": 40, "company": 25, "family": 20, "track": 10}
FAMILY, SEASON, PLACE, SIZE, GRADUATION, MILESTONE, OPENING = 10, 8, 8, 6, 8, 30, 12
STALE_DAYS = 7


def padded(c: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def place_matches(wanted: Column, location: Column) -> Column:
    """Whether a wanted place holds the location or the location a wanted place, as whole words."""
    here = padded(location)
    one = lambda p: (F.length(padded(p)) > 2) & (F.length(here) > 2) & (F.contains(here, padded(p)) | F.contains(padded(p), here))
    return F.coalesce(F.exists(F.filter(wanted, lambda p: p.isNotNull()), one), F.lit(False))


def followed(roles: DataFrame, follows: DataFrame) -> DataFrame:
    """(user_id, role_id, followed_by): an equal-key join for each scope, and the scopes that admit a role."""
    told = follows.select("user_id", "kind", "target").distinct()
    keys = {"role": F.col("role_id").cast("string"), "company": F.col("company_id").cast("string"), "family": F.col("family"), "track": F.col("level")}
    parts = [roles.select("role_id", key.alias("target")).join(told.where(F.col("kind") == kind).select("user_id", "target"), "target").select("user_id", "role_id", F.lit(kind).alias("kind")) for kind, key in keys.items()]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("user_id", "role_id").agg(F.array_sort(F.collect_set("kind")).alias("followed_by"))


def scored(pairs: DataFrame, as_of: Column) -> DataFrame:
    """``rank_score``, ``rank_reasons`` and ``next_on`` of pairs that hold the role's, the forecast's and the user's columns."""
    has = lambda wanted, c: F.coalesce(F.array_contains(wanted, F.col(c)), F.lit(False))
    level = F.array_max(F.transform(F.filter("priority_companies", lambda p: p["company_id"] == F.col("company_id")), lambda p: F.least(F.greatest(p["level"], F.lit(1)), F.lit(5))))
    year, out = F.year(as_of), F.col("graduation_year")
    fits = ((F.col("level") == "internship") & (out > year)) | ((F.col("level") == "new_grad") & out.between(year, year + 1))
    days, wait = F.datediff("due_on", as_of), F.datediff("expected_on", as_of)
    urgent = F.greatest(F.lit(0), F.least(F.lit(MILESTONE), MILESTONE - days))
    near = F.when(wait >= 0, F.greatest(F.lit(0), OPENING - F.floor(wait / 7).cast("int"))).otherwise(0)
    specific = F.array_max(F.transform("followed_by", lambda k: F.element_at(F.create_map(*[F.lit(x) for p in SCOPES.items() for x in p]), k)))
    points = [
        ("follow", specific), ("priority_company", F.coalesce(10 + 2 * level, F.lit(0))), ("family", F.when(has(F.col("families"), "family"), FAMILY)), ("season", F.when(has(F.col("seasons"), "season"), SEASON)),
        ("location", F.when(place_matches(F.col("places"), F.col("location")), PLACE)), ("size", F.when(has(F.col("sizes"), "size"), SIZE)), ("graduation", F.when(fits, GRADUATION)),
        ("milestone", F.when(F.col("due_on").isNotNull(), urgent)), ("opening", F.when(F.col("due_on").isNull(), near)),
    ]
    reasons = F.filter(F.array(*[F.struct(F.lit(n).alias("reason"), F.coalesce(p, F.lit(0)).cast("int").alias("points")) for n, p in points]), lambda x: x["points"] > 0)
    return pairs.withColumn("rank_reasons", reasons).withColumn("rank_score", F.aggregate("rank_reasons", F.lit(0), lambda a, x: a + x["points"])).withColumn("next_on", F.coalesce("due_on", "expected_on"))


def _eligible(roles: DataFrame, follows: DataFrame, forecasts: DataFrame, as_of: Column) -> DataFrame:
    return followed(roles, follows).join(forecasts, "role_id").withColumn("stale", F.datediff(as_of, F.col("forecast_as_of")) > STALE_DAYS)


def timeline(roles: DataFrame, follows: DataFrame, preferences: DataFrame, forecasts: DataFrame, as_of: Column, size: int = 50) -> DataFrame:
    """Each user's first ``size`` roles by score, then by the next date, then by role. Spark cuts every task's rows of a
    user to ``size`` before the shuffle, so a user who follows everything is not one great group."""
    live = _eligible(roles, follows, forecasts, as_of).where(~F.col("stale")).drop("stale")
    rows = scored(live.join(roles, "role_id").join(preferences, "user_id", "left"), as_of)
    by = Window.partitionBy("user_id").orderBy(F.col("rank_score").desc(), F.col("next_on").asc_nulls_last(), "role_id")
    return rows.withColumn("place", F.row_number().over(by)).where(F.col("place") <= size).select("user_id", "place", "role_id", "rank_score", "rank_reasons", "followed_by", "next_on")


def excluded(roles: DataFrame, follows: DataFrame, forecasts: DataFrame, as_of: Column) -> DataFrame:
    """How many followed roles of each user have only a stale forecast."""
    return _eligible(roles, follows, forecasts, as_of).groupBy("user_id").agg(F.count_if("stale").alias("excluded_stale"), F.count("*").alias("followed"))
