"""The timeline of followed roles and the watched roles' next steps, over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell import standins as S
from tidewell.operators import timeline as T
from tidewell.plans.facets import _FOLLOWS, follows
from tidewell.plans.reads import _PLAN, _plan
from tidewell.registry import query
from tidewell.session import load

AS_OF, MONTH_END, HORIZON, PAGE = "2000-06-01", "2000-06-30", 45, 20
_PLACES = ("New York, NY", "Remote - US", "London, UK", "San Francisco Bay Area", "")
_WANTED = (("new york", "paris"), ("Remote US or Canada", "remote us"), ("Greater London UK region", ""), ("york",), ("Francisco bay",))
_SIZES = ("startup", "small", "medium", "large", "enterprise")
_FAMILIES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_SEASONS = ("summer", "fall", "winter")


def _at(values, i):
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values)).cast("int") + 1)


def _inputs(spark, d):
    r = S.roles(spark, d)
    roles = r.select("role_id", "company_id", "family", "level", "season", _at(_PLACES, F.col("role_id")).alias("location"), _at(_SIZES, F.col("company_id")).alias("size"))
    told = follows(spark, d)
    u = F.col("user_id")
    wanted = F.element_at(F.array(*[F.array(*map(F.lit, w)) for w in _WANTED]), (u % 5).cast("int") + 1)
    prefs = told.select("user_id").distinct().select(
        u, F.array(F.struct((u % 25).alias("company_id"), (u % 5 + 1).cast("int").alias("level")), F.struct(((u + 7) % 25).alias("company_id"), F.lit(3).alias("level"))).alias("priority_companies"),
        F.array(_at(_FAMILIES, u)).alias("families"), F.array(_at(_SEASONS, u)).alias("seasons"), F.when(u % 7 != 0, wanted).alias("places"), F.array(_at(_SIZES, u), F.lit("startup")).alias("sizes"), (u % 4 + 1999).cast("int").alias("graduation_year"),
    )
    as_of = F.to_date(F.lit(AS_OF))
    newest = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("role_id")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("k"))
    k = F.col("k")
    forecasts = newest.select("role_id", F.date_sub(as_of, (k % 10).cast("int")).alias("forecast_as_of"), F.date_add(as_of, (k % 120 - 5).cast("int")).alias("expected_on"), F.when(k % 3 == 0, F.date_add(as_of, (k % 50 - 5).cast("int"))).alias("due_on"))
    return roles, told, prefs, forecasts, as_of


def _list(values):
    return "[" + ", ".join(_list(v) if isinstance(v, tuple) else "'" + v + "'" for v in values) + "]"


_PAD = lambda x: f"(' ' || trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ')"
_SQL = f"""{_FOLLOWS}, role as (select *, {_list(_PLACES)}[(role_id % 5)::int + 1] as location, {_list(_SIZES)}[(company_id % 5)::int + 1] as size from roles),
    newest as (select o_custkey as role_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as k from orders group by 1),
    forecast as (select role_id, date '{AS_OF}' - (k % 10)::int as forecast_as_of, date '{AS_OF}' + (k % 120 - 5)::int as expected_on, case when k % 3 = 0 then date '{AS_OF}' + (k % 50 - 5)::int end as due_on from newest),
    hit as (select distinct user_id, role_id, kind from role r join follows f on (kind = 'role' and target = role_id::varchar) or (kind = 'company' and target = company_id::varchar) or (kind = 'family' and target = family) or (kind = 'track' and target = level)),
    pair as (select user_id, role_id, list_sort(list(kind)) as followed_by, max(case kind when 'role' then 40 when 'company' then 25 when 'family' then 20 else 10 end) as follow from hit group by 1, 2),
    asked as (select *, date '{AS_OF}' - forecast_as_of > 7 as stale from pair join forecast using (role_id)),
    pointed as (select a.*, coalesce(due_on, expected_on) as next_on, list_filter([{{'reason': 'follow', 'points': follow}},
        {{'reason': 'priority_company', 'points': greatest(case when company_id = user_id % 25 then 12 + 2 * (user_id % 5) else 0 end, case when company_id = (user_id + 7) % 25 then 16 else 0 end)}},
        {{'reason': 'family', 'points': case when family = {_list(_FAMILIES)}[(user_id % 5)::int + 1] then 10 else 0 end}}, {{'reason': 'season', 'points': case when season = {_list(_SEASONS)}[(user_id % 3)::int + 1] then 8 else 0 end}},
        {{'reason': 'location', 'points': case when user_id % 7 <> 0 and location <> '' and len(list_filter({_list(_WANTED)}[(user_id % 5)::int + 1], lambda p: p <> '' and (contains({_PAD('location')}, {_PAD('p')}) or contains({_PAD('p')}, {_PAD('location')})))) > 0 then 8 else 0 end}},
        {{'reason': 'size', 'points': case when size in ('startup', {_list(_SIZES)}[(user_id % 5)::int + 1]) then 6 else 0 end}}, {{'reason': 'graduation', 'points': case when level = 'internship' and user_id % 4 + 1999 > 2000 or level = 'new_grad' and user_id % 4 + 1999 in (2000, 2001) then 8 else 0 end}},
        {{'reason': 'milestone', 'points': case when due_on is not null then greatest(0, least(30, 30 - (due_on - date '{AS_OF}'))) else 0 end}}, {{'reason': 'opening', 'points': case when due_on is null and expected_on >= date '{AS_OF}' then greatest(0, 12 - (expected_on - date '{AS_OF}') // 7) else 0 end}}], lambda x: x.points > 0) as rank_reasons
        from asked a join role using (role_id) where not stale),
    summed as (select *, list_sum(list_transform(rank_reasons, lambda x: x.points)) as rank_score from pointed),
    placed as (select *, row_number() over (partition by user_id order by rank_score desc, next_on nulls last, role_id) as place from summed)"""


@query("followed_timeline", S.with_sql("roles", f", {_SQL} select user_id, place, role_id, rank_score::int as rank_score, array_to_string(list_transform(rank_reasons, lambda x: x.reason || ' +' || x.points), ', ') as reasons, array_to_string(followed_by, ', ') as followed_by, next_on from placed where place <= {PAGE}"))
def followed_timeline(spark, d):
    t = T.timeline(*_inputs(spark, d), size=PAGE)
    reasons = F.array_join(F.transform("rank_reasons", lambda x: F.concat(x["reason"], F.lit(" +"), x["points"].cast("string"))), ", ")
    return t.select("user_id", F.col("place").cast("bigint").alias("place"), "role_id", "rank_score", reasons.alias("reasons"), F.array_join("followed_by", ", ").alias("followed_by"), "next_on")


@query("timeline_excluded", S.with_sql("roles", f", {_SQL} select user_id, count(*) filter (stale) as excluded_stale, count(*) as followed from asked group by 1"))
def timeline_excluded(spark, d):
    roles, told, _, forecasts, as_of = _inputs(spark, d)
    return T.excluded(roles, told, forecasts, as_of)


def _watched_steps(spark, d, action, until):
    """The steps of one kind that users' watched roles reach from the day of the question on."""
    watched = follows(spark, d).where("kind = 'role'").select("user_id", F.col("target").cast("bigint").alias("role_id")).distinct()
    steps = _plan(spark, d).where((F.col("action") == action) & F.col("due_on").between(F.to_date(F.lit(AS_OF)), until))
    role = load(spark, d, "orders").select(F.col("o_orderkey").alias("forecast_id"), F.col("o_custkey").alias("role_id"))
    return watched.join(steps.join(role, "forecast_id"), "role_id").select("user_id", "role_id", "forecast_id", "due_on", "overdue")


_WATCHED = f"with {_PLAN}, {_FOLLOWS}, watched as (select distinct user_id, target::bigint as role_id from follows where kind = 'role') select user_id, role_id, forecast_id, due_on, overdue from plan join orders on o_orderkey = forecast_id join watched on role_id = o_custkey"


@query("watched_networking", f"{_WATCHED} where action = 'networking' and due_on between date '{AS_OF}' and date '{MONTH_END}'")
def watched_networking(spark, d):
    return _watched_steps(spark, d, "networking", F.last_day(F.to_date(F.lit(AS_OF))))


@query("referral_ready", f"{_WATCHED} where action = 'referral' and due_on between date '{AS_OF}' and date '{AS_OF}' + {HORIZON}")
def referral_ready(spark, d):
    return _watched_steps(spark, d, "referral", F.date_add(F.to_date(F.lit(AS_OF)), HORIZON))
