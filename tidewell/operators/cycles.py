"""Recruiting cycles: which openings belong to one year's round, and who represents it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Days from a cycle's first opening within which unkeyed ones join it; precision ranks.
CYCLE_DAYS = 300
RANK = {"exact": 2, "bounded": 1, "observed_by": 0}


def precision_rank(c: Column) -> Column:
    return F.when(c == "exact", 2).when(c == "bounded", 1).otherwise(0)


def assign(events: DataFrame, *keys: str) -> DataFrame:
    """``events`` with ``cycle``. Rows with a cycle_key share the cycle of that key. The others are
    taken by (opened_on, event_id): one joins the last unkeyed cycle of its role when it
    opened less than CYCLE_DAYS after that cycle's first, else it starts a cycle.

    The anchor rule is a fold (a session window would chain from the event before),
    so dates of one role are folded as one array: a role's own history, nothing wider."""
    keys = keys or ("role_id",)
    dates = events.where("cycle_key is null").groupBy(*keys).agg(F.array_sort(F.collect_set("opened_on")).alias("days"))

    def step(anchors: Column, day: Column) -> Column:
        near = (F.size(anchors) > 0) & (F.datediff(day, F.element_at(anchors, -1)) < CYCLE_DAYS)
        return F.when(near, anchors).otherwise(F.concat(anchors, F.array(day)))

    anchors = dates.select(*keys, F.aggregate("days", F.array().cast("array<date>"), lambda a, d: F.when(F.size(a) == 0, F.array(d)).otherwise(step(a, d))).alias("anchors"))
    joined = events.join(anchors, list(keys), "left")
    own = F.array_max(F.filter("anchors", lambda a: a <= F.col("opened_on")))
    return joined.withColumn("cycle", F.when(F.col("cycle_key").isNotNull(), F.concat(F.lit("key:"), "cycle_key")).otherwise(F.concat(F.lit("from:"), own.cast("string")))).drop("anchors")


def preference(within: WindowSpec) -> WindowSpec:
    """The order in which events stand for their cycle."""
    return within.orderBy(
        F.col("opened_on"), precision_rank(F.col("precision")).desc(), F.col("match").desc(), F.col("quality").desc(), F.col("uncertainty").asc_nulls_last(), F.col("available_on"), F.col("event_id")
    )


def collapse(events: DataFrame, *keys: str) -> DataFrame:
    """One row for each cycle: its earliest opening, the best evidence among equals."""
    keys = keys or ("role_id",)
    order = preference(Window.partitionBy(*keys, "cycle"))
    return events.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def _best(events: DataFrame, *keys: str) -> DataFrame:
    """Events of a group with the days on which each is the best one known: from_on, and until_on when a better one comes."""
    better = preference(Window.partitionBy(*keys)).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("until_on", F.min("from_on").over(better)).where("until_on is null or from_on < until_on")


def standing(events: DataFrame) -> DataFrame:
    """Each event with the days on which it stands for a cycle, cycles being grouped anew from what is known on each day.

    A later known event can move the days from which cycles count, so an event may stand for its cycle, lose
    that place and take it again: a row for each such span. What is known changes on days only, and a cycle
    is stood for by an event of its first day, so a role gives a row for each of its days and cycles, not pairs of events."""
    known = events.withColumn("from_on", F.greatest("opened_on", "available_on"))
    keyed = _best(known.where("cycle_key is not null"), "role_id", "cycle_key")
    bare = known.where("cycle_key is null")
    day = F.struct("opened_on", "at")
    days = bare.groupBy("role_id", "opened_on").agg(F.min("from_on").alias("at")).groupBy("role_id").agg(F.array_sort(F.collect_list(day)).alias("days"))
    news = days.withColumn("news", F.array_sort(F.array_distinct(F.transform("days", lambda d: d["at"])))).select("role_id", "days", F.posexplode("news").alias("i", "since"), F.col("news").alias("all"))

    def step(anchors: Column, d: Column) -> Column:
        near = (F.size(anchors) > 0) & (F.datediff(d["opened_on"], F.element_at(anchors, -1)) < CYCLE_DAYS)
        return F.when((d["at"] > F.col("since")) | F.coalesce(near, F.lit(False)), anchors).otherwise(F.concat(anchors, F.array(d["opened_on"])))

    first = F.aggregate("days", F.array().cast("array<date>"), lambda a, d: F.when(F.size(a) == 0, F.when(d["at"] > F.col("since"), a).otherwise(F.array(d["opened_on"]))).otherwise(step(a, d)))
    turns = news.select("role_id", "i", F.explode(first).alias("opened_on"), "since", F.get("all", F.col("i") + 1).alias("till"))
    # Spans that follow each other without a break are one.
    row = Window.partitionBy("role_id", "opened_on").orderBy("i")
    turns = turns.withColumn("run", F.col("i") - F.row_number().over(row)).groupBy("role_id", "opened_on", "run").agg(F.min("since").alias("since"), F.max_by("till", "i").alias("till"))
    joined = _best(bare, "role_id", "opened_on").join(turns, ["role_id", "opened_on"])
    both = joined.withColumns({"from_on": F.greatest("from_on", "since"), "until_on": F.least("until_on", "till")}).where("until_on is null or from_on < until_on")
    return keyed.unionByName(both.select(keyed.columns))


#: DuckDB: cycles of the reading ``openings`` (a recursive walk over each role's unkeyed dates) and their representatives.
SQL = """
unkeyed as (select role_id, opened_on, row_number() over (partition by role_id order by opened_on) as rn
    from (select distinct role_id, opened_on from openings where cycle_key is null)),
walk as (
    select role_id, rn, opened_on, opened_on as anchor from unkeyed where rn = 1
    union all
    select u.role_id, u.rn, u.opened_on, case when u.opened_on - w.anchor < 300 then w.anchor else u.opened_on end
    from walk w join unkeyed u on u.role_id = w.role_id and u.rn = w.rn + 1),
cycled as (select o.*, case when o.cycle_key is not null then 'key:' || o.cycle_key else 'from:' || w.anchor::varchar end as cycle
    from openings o left join walk w on o.cycle_key is null and w.role_id = o.role_id and w.opened_on = o.opened_on),
collapsed as (select * exclude (rn) from (select *, row_number() over (partition by role_id, cycle order by opened_on,
    case precision when 'exact' then 2 when 'bounded' then 1 else 0 end desc, match desc, quality desc,
    uncertainty asc nulls last, available_on, event_id) as rn from cycled) where rn = 1)"""
