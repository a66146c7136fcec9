"""Faceted list reads on the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell import standins as S
from tidewell.operators import facets as X
from tidewell.registry import query

PARAMS = dict(disciplines=["BUILDING", "MACHINERY", "FURNITURE"], window_days=150, min_cycles=5, precision="exact_or_bounded", bands=["strong", "moderate"], query="customer nation_1", levels=["internship", "new_grad"])

FACTS_SQL = """counts as (select role_id, count(*) as history_count, count(*) filter (precision = 'exact') as exact_count, count(*) filter (precision = 'bounded') as bounded_count,
    count(*) filter (precision = 'observed_by') as observed_count, max(year(opened_on))::int as target_year, max(opened_on) as latest from openings group by 1),
facts as (select r.role_id, company, family as discipline, level, season, target_year, 'region ' || region_id as location, coalesce(latest >= date '2001-01-01', false) as listed, r.role_id % 11 = 0 as followed,
    coalesce(history_count, 0) >= 3 as forecastable, case when history_count >= 3 then (r.role_id * 37) % 100 end as confidence, case when history_count >= 3 then (r.role_id * 13) % 200 end as days_until,
    coalesce(history_count, 0) as history_count, coalesce(exact_count, 0) as exact_count, coalesce(bounded_count, 0) as bounded_count, coalesce(observed_count, 0) as observed_count,
    lower(concat_ws(' ', title, company, family)) as search_text from roles r join companies using (company_id) left join counts using (role_id))"""
FLAGS_SQL = FACTS_SQL + """,
flags as (select *, list_aggregate([contains(search_text, w) for w in ['customer', 'nation_1']], 'bool_and') as is_query, coalesce(discipline in ('BUILDING','MACHINERY','FURNITURE'), false) as is_discipline, true as is_company,
    coalesce(level in ('internship','new_grad'), false) as is_type, true as is_season, true as is_year, coalesce(forecastable and days_until <= 150, false) as is_window,
    case when confidence is null then 'none' when confidence >= 75 then 'strong' when confidence >= 60 then 'moderate' else 'limited' end in ('strong','moderate') as is_confidence, coalesce(history_count >= 5, false) as is_cycles,
    exact_count > 0 or bounded_count > 0 as is_precision, true as is_location, true as is_listed, true as is_watched from facts),
flagged as (select *, is_query and is_discipline and is_type and is_window and is_confidence and is_cycles and is_precision as matching from flags)"""
_BASE = "openings roles companies"
_ORDER = "forecastable desc nulls last, days_until asc nulls last, confidence desc nulls last, history_count desc nulls last, company asc nulls last, role_id"


def facts(spark, d):
    """Role facts: one aggregate of openings joined to its dimensions."""
    o = S.openings(spark, d)
    count = lambda p: F.count_if(F.col("precision") == p)
    counts = o.groupBy("role_id").agg(F.count("*").alias("history_count"), count("exact").alias("exact_count"), count("bounded").alias("bounded_count"), count("observed_by").alias("observed_count"), F.max(F.year("opened_on")).alias("target_year"), F.max("opened_on").alias("latest"))
    r = S.roles(spark, d).join(S.companies(spark, d), "company_id").join(counts, "role_id", "left")
    enough = F.col("history_count") >= 3
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return r.select(
        "role_id", "company", F.col("family").alias("discipline"), "level", "season", "target_year", F.concat(F.lit("region "), F.col("region_id").cast("string")).alias("location"),
        F.coalesce(F.col("latest") >= F.lit("2001-01-01").cast("date"), F.lit(False)).alias("listed"), (F.pmod("role_id", F.lit(11)) == 0).alias("followed"), F.coalesce(enough, F.lit(False)).alias("forecastable"),
        F.when(enough, F.pmod(F.col("role_id") * 37, F.lit(100))).alias("confidence"), F.when(enough, F.pmod(F.col("role_id") * 13, F.lit(200))).alias("days_until"),
        zero("history_count"), zero("exact_count"), zero("bounded_count"), zero("observed_count"), F.lower(F.concat_ws(" ", "title", "company", "family")).alias("search_text"),
    )


def flagged(spark, d):
    return X.flags(facts(spark, d), **PARAMS)


@query("facet_flags", S.with_sql(_BASE, f", {FLAGS_SQL} select role_id, {', '.join('is_' + k for k in X.FACETS)}, matching from flagged"))
def facet_flags(spark, d):
    return flagged(spark, d).select("role_id", *[f"is_{k}" for k in X.FACETS], "matching")


@query("facet_page", S.with_sql(_BASE, f""", {FLAGS_SQL} select role_id, company, discipline, days_until, confidence, history_count, company_rank from (
    select *, row_number() over (partition by company order by {_ORDER}) as company_rank from flagged where matching) where company_rank <= 3 order by {_ORDER} limit 25"""))
def facet_page(spark, d):
    return X.page(flagged(spark, d)).select("role_id", "company", "discipline", "days_until", "confidence", "history_count", "company_rank")


@query("facet_page_by_history", S.with_sql(_BASE, f""", {FACTS_SQL} select role_id, company, history_count, exact_count from facts order by history_count desc, exact_count desc, company, role_id limit 20 offset 10"""))
def facet_page_by_history(spark, d):
    return X.page(X.flags(facts(spark, d)), "history", cap=None, size=20, offset=10).select("role_id", "company", "history_count", "exact_count")


_OTHERS = lambda k: " and ".join(f"is_{x}" for x in X.FACETS if x != k)


_SUMMARY_SQL = f"""summary as (select count(*) as total, count(*) filter (matching) as matching, count(*) filter (matching and coalesce(days_until <= 30, false)) as soon, count(*) filter (matching and followed) as followed,
    {', '.join(f"count(*) filter (not is_{k}) as excluded_{k}, count(*) filter ({_OTHERS(k)}) as without_{k}" for k in X.FACETS)},
    (select sum(least(n, 3)) from (select company, count(*) filter (matching) as n from flagged group by 1))::bigint as shown,
    (count(*) filter (matching) - (select sum(least(n, 3)) from (select company, count(*) filter (matching) as n from flagged group by 1)))::bigint as collapsed from flagged)"""


@query("exclusion_matrix", S.with_sql(_BASE, f", {FLAGS_SQL}, {_SUMMARY_SQL} select * from summary"))
def exclusion_matrix(spark, d):
    return X.summary(flagged(spark, d))


@query("relax_suggestion", S.with_sql(_BASE, f""", {FLAGS_SQL}, {_SUMMARY_SQL} select matching, facet, rows from summary, lateral (select 'discipline' as facet, without_discipline as rows, 0 as t union all
    select 'window', without_window, 1 union all select 'confidence', without_confidence, 2 union all select 'query', without_query, 3) where rows > matching order by rows desc, t limit 1"""))
def relax_suggestion(spark, d):
    return X.relax(X.summary(flagged(spark, d)), ["discipline", "window", "confidence", "query"])


@query("facet_options", S.with_sql(_BASE, f", {FACTS_SQL} " + " union all ".join(f"select '{c}' as facet, {c}::varchar as value, count(*) as rows from facts where {c} is not null group by 2" for c in ("discipline", "level", "season", "target_year", "company", "location"))))
def facet_options(spark, d):
    return X.options(facts(spark, d))


@query("history_depth", S.with_sql(_BASE, f", {FACTS_SQL} select case when forecastable then least(history_count, 3) end as depth, count(*) as roles from facts group by 1"))
def history_depth(spark, d):
    f = facts(spark, d)
    return f.groupBy(F.when(F.col("forecastable"), F.least("history_count", F.lit(3))).alias("depth")).agg(F.count("*").alias("roles"))


@query("precision_counts", S.with_sql(_BASE, f", {FACTS_SQL} select role_id, exact_count, bounded_count, observed_count from facts"))
def precision_counts(spark, d):
    return facts(spark, d).select("role_id", "exact_count", "bounded_count", "observed_count")


@query("latest_per_key", "select o_custkey as role_id, o_orderkey as event_id, o_orderdate::date as opened_on from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as r from orders) where r = 1")
def latest_per_key(spark, d):
    w = Window.partitionBy("role_id").orderBy(F.col("opened_on").desc(), F.col("event_id"))
    return S.openings(spark, d).select("role_id", "event_id", "opened_on").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


_FOLLOWS = """follows as (select c_custkey % 40 as user_id, case c_custkey % 4 when 0 then 'role' when 1 then 'company' when 2 then 'family' else 'track' end as kind,
    case c_custkey % 4 when 0 then (c_custkey * 7 % 150)::varchar when 1 then (c_nationkey)::varchar when 2 then c_mktsegment else ['internship','new_grad','apprenticeship','unknown'][(c_custkey // 4 % 4)::int + 1] end as target
    from customer)"""


def follows(spark, d):
    c = S.load(spark, d, "customer")
    kind = F.pmod("c_custkey", F.lit(4))
    level = F.element_at(F.array(*map(F.lit, ("internship", "new_grad", "apprenticeship", "unknown"))), F.pmod(F.floor(F.col("c_custkey") / 4), F.lit(4)).cast("int") + 1)
    target = F.when(kind == 0, F.pmod(F.col("c_custkey") * 7, F.lit(150)).cast("string")).when(kind == 1, F.col("c_nationkey").cast("string")).when(kind == 2, F.col("c_mktsegment")).otherwise(level)
    return c.select(F.pmod("c_custkey", F.lit(40)).alias("user_id"), F.when(kind == 0, "role").when(kind == 1, "company").when(kind == 2, "family").otherwise("track").alias("kind"), target.alias("target"))


def covered_roles(roles, follow_rows):
    """(user_id, role_id) of roles a user follows directly, by company, by family or by track: four
    equal-key joins united. An OR in one condition would compare every role with every follow. Follows
    that say the same are one before they meet roles, so a pair arises at most once a kind."""
    follow_rows = follow_rows.select("user_id", "kind", "target").distinct()
    keyed = {"role": F.col("role_id").cast("string"), "company": F.col("company_id").cast("string"), "family": F.col("family"), "track": F.col("level")}
    parts = [roles.select("role_id", key.alias("target")).join(follow_rows.where(F.col("kind") == kind).select("user_id", "target"), "target").select("user_id", "role_id") for kind, key in keyed.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


@query("follow_coverage", S.with_sql("roles", f""", {_FOLLOWS} select distinct user_id, role_id from roles r join follows f on (kind = 'role' and target = role_id::varchar) or (kind = 'company' and target = company_id::varchar)
    or (kind = 'family' and target = family) or (kind = 'track' and target = level)"""))
def follow_coverage(spark, d):
    return covered_roles(S.roles(spark, d), follows(spark, d))


@query("watchers_by_role", S.with_sql("roles", f""", {_FOLLOWS} select role_id, list_sort(list(distinct user_id)) as watchers from roles r join follows f on (kind = 'role' and target = role_id::varchar) or (kind = 'company' and target = company_id::varchar)
    or (kind = 'family' and target = family) or (kind = 'track' and target = level) group by 1"""))
def watchers_by_role(spark, d):
    return covered_roles(S.roles(spark, d), follows(spark, d)).groupBy("role_id").agg(F.array_sort(F.collect_set("user_id")).alias("watchers"))


@query("listed_now", S.with_sql("", """fetched as (select l_suppkey as source_id, max(l_shipdate) as fetched_at from lineitem group by 1)
    select distinct o_custkey as role_id from lineitem join orders on o_orderkey = l_orderkey join fetched f on f.source_id = l_suppkey where l_shipdate >= f.fetched_at - interval 10 day""".strip()).replace("with recursive \n", "with "))
def listed_now(spark, d):
    li = S.load(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
    newest = li.groupBy("l_suppkey").agg(F.max("l_shipdate").alias("fetched_at"))
    live = li.join(newest, "l_suppkey").where(F.col("l_shipdate") >= F.col("fetched_at") - F.expr("interval 10 days"))
    return S.load(spark, d, "orders").join(live.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select(F.col("o_custkey").alias("role_id")).distinct()


@query("onboarding_seed", S.with_sql(_BASE, f""", {FACTS_SQL} select role_id, company, confidence, total from (select *, row_number() over (partition by company order by {_ORDER}) as r, (select count(*) from facts where forecastable) as total
    from facts where forecastable) where r <= 2 order by {_ORDER} limit 20"""))
def onboarding_seed(spark, d):
    f = facts(spark, d).where("forecastable")
    # The count over all rows is one row joined on, not a window over everything.
    top = X.page(X.flags(f), "opening", cap=2, size=20)
    total = f.agg(F.count("*").alias("total"))
    return top.withColumn("total", total.scalar()).select("role_id", "company", "confidence", "total")


@query("featured_program", S.with_sql(_BASE, f""", {FACTS_SQL}, gaps as (select role_id, year(opened_on) as y, coalesce(lead(doy) over w - doy, 365 - doy + min(doy) over (partition by role_id)) as gap from (select *, least(dayofyear(opened_on), 365) as doy from openings) window w as (partition by role_id order by doy, event_id)),
    rhythm as (select role_id, count(distinct y) as years, 365 - max(gap) as width from gaps group by 1)
    select role_id, years, width from rhythm join facts using (role_id) order by years >= 3 desc, case when years >= 3 then width end nulls last, years desc, days_until nulls last, role_id limit 1""".replace("years desc,", "case when years < 3 then years end desc nulls last,")))
def featured_program(spark, d):
    """Of roles with openings in three years or more, the one whose days lie closest together on the circle of the year; else
    the one of most years."""
    o = S.openings(spark, d).withColumn("doy", F.least(F.dayofyear("opened_on"), F.lit(365)))
    gap = F.coalesce(F.lead("doy").over(Window.partitionBy("role_id").orderBy("doy", "event_id")) - F.col("doy"), 365 - F.col("doy") + F.min("doy").over(Window.partitionBy("role_id")))
    s = o.withColumn("gap", gap).groupBy("role_id").agg(F.countDistinct(F.year("opened_on")).alias("years"), (365 - F.max("gap")).alias("width"))
    j = s.join(facts(spark, d).select("role_id", "days_until"), "role_id")
    steady = F.col("years") >= 3
    order = (steady.desc(), F.when(steady, F.col("width")).asc_nulls_last(), F.when(~steady, F.col("years")).desc_nulls_last(), F.col("days_until").asc_nulls_last(), F.col("role_id"))
    return j.orderBy(*order).limit(1).select("role_id", "years", "width")
