"""Forecast versions, what changed between them, and rules on signals and captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The newest changes listed, the versions shown, days a forecast stays fresh, lines of a snippet.
NEWEST, VERSIONS, FRESH_DAYS, LINES = 6, 8, 7, 5
#: Bounds of a limiting and of a supporting factor, and of one that counts the other way round.
LIMITS, SUPPORTS, AGAINST_OK, AGAINST_BAD = 0.55, 0.75, 0.25, 0.45
AGAINST = ("signal_contradiction", "signal_conflict")


def changes(versions: DataFrame) -> DataFrame:
    """(role_id, before_id, after_id, changed_on): each version of a role with the one before it."""
    w = Window.partitionBy("role_id").orderBy("forecasted_on", "forecast_id")
    return versions.select("role_id", F.lag("forecast_id").over(w).alias("before_id"), F.col("forecast_id").alias("after_id"), F.col("forecasted_on").alias("changed_on")).where("before_id is not null")


def lineage(change: DataFrame, versions: DataFrame) -> DataFrame:
    """Changes with the forecast before and after them, the days that the window moved, and whether a reader feels it."""
    side = lambda p: versions.select(*[F.col(c).alias(f"{p}_{c}") for c in ("forecast_id", "window_start", "window_end", "word")])
    j = change.join(side("b"), F.col("before_id") == F.col("b_forecast_id")).join(side("a"), F.col("after_id") == F.col("a_forecast_id"))
    start, end = F.datediff("a_window_start", "b_window_start"), F.datediff("a_window_end", "b_window_end")
    return j.select("role_id", "before_id", "after_id", "changed_on", start.alias("start_delta"), end.alias("end_delta"), ((start != 0) | (end != 0) | (F.col("a_word") != F.col("b_word"))).alias("felt"))


def newest(rows: DataFrame, key: str, *order: Column, n: int = 1) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= n)


def current(latest: DataFrame, refusals: DataFrame, as_of: Column) -> DataFrame:
    """Latest forecasts that no later refusal withdrew, and whether they are stale."""
    j = latest.join(refusals, "role_id", "left").where(F.col("refused_on").isNull() | (F.col("forecasted_on") > F.col("refused_on")))
    return j.withColumn("stale", F.datediff(as_of, F.coalesce("verified_on", "forecasted_on")) > FRESH_DAYS)


def effect(name: Column, value: Column) -> Column:
    against = F.when(value <= AGAINST_OK, "supports").when(value > AGAINST_BAD, "limits").otherwise("neutral")
    return F.when(name.isin(*AGAINST), against).when(value < LIMITS, "limits").when(value >= SUPPORTS, "supports").otherwise("neutral")


def resolve_signals(evidence: DataFrame, roles: DataFrame) -> DataFrame:
    """``role`` of each evidence row: the role of its company whose two or more tokens it holds all of, the one
    with most tokens; null on a tie or none. Roles meet evidence by company and their first token only."""
    keyed = roles.where(F.size("tokens") >= 2).select("company", "role", "tokens", F.array_min("tokens").alias("token"))
    held = evidence.select("evidence_id", "company", "words", F.explode(F.array_distinct("words")).alias("token"))
    hit = held.join(keyed, ["company", "token"]).where(F.size(F.array_except("tokens", "words")) == 0)
    # Pre-aggregated: the best size, and the roles that reach it counted by their least and greatest.
    by_size = hit.groupBy("evidence_id", F.size("tokens").alias("n")).agg(F.min("role").alias("lo"), F.max("role").alias("hi"))
    best = by_size.groupBy("evidence_id").agg(F.max(F.struct("n", "lo", "hi")).alias("b")).select("evidence_id", F.when(F.col("b.lo") == F.col("b.hi"), F.col("b.lo")).alias("role"))
    return evidence.select("evidence_id").join(best, "evidence_id", "left")


def insert_once(incoming: DataFrame, stored: DataFrame, identity: str, semantic: list[str], seq: str) -> DataFrame:
    """Rows to insert: of neither a stored identity nor a stored (role, observation, kind), the first of each in the batch."""
    fresh = incoming.join(stored.select(identity).distinct(), identity, "left_anti").join(stored.select(*semantic).distinct(), semantic, "left_anti")
    one = newest(fresh, identity, F.col(seq)).drop("_r")
    return one.withColumn("_r", F.row_number().over(Window.partitionBy(*semantic).orderBy(seq))).where("_r = 1").drop("_r")


def added_lines(before: Column, after: Column, relevant: str) -> Column:
    """Lines of ``after`` that ``before`` lacks in any case and that ``relevant`` matches, the first few joined."""
    old = F.transform(F.split(before, "\n"), F.lower)
    new = F.filter(F.split(after, "\n"), lambda x: ~F.array_contains(old, F.lower(x)) & F.lower(x).rlike(relevant))
    return F.array_join(F.slice(new, 1, LINES), " · ")


def fingerprint(components: Column) -> Column:
    """sha256 over components in the order of their names, so equal inputs give equal fingerprints."""
    return F.sha2(F.array_join(F.array_sort(components), "\n"), 256)
