"""Reviews and splits of roles as changes of several tables, on the supplied tables.

role = customer, observation = order, alias = every third order, opening = filled order, follower = customer's nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import revisions as V
from tidewell.registry import query
from tidewell.session import load

_LEVELS = ("internship", "new_grad", "apprenticeship", "unknown")


def _level(k):
    return F.element_at(F.array(*map(F.lit, _LEVELS)), (F.pmod(k, F.lit(4)) + 1).cast("int"))


def _split(spark, d):
    c, o = load(spark, d, "customer"), load(spark, d, "orders")
    k = F.col("c_custkey")
    roles = c.select(k.alias("role_id"), F.col("c_nationkey").alias("company_id"), F.col("c_name").alias("title"), _level(k).alias("level"), V.track(_level(k)).alias("track"), F.lit(True).alias("active"), F.lit(None).cast("bigint").alias("superseded_by"))
    matches = o.select(F.col("o_custkey").alias("role_id"), F.col("o_orderkey").alias("observation_id"))
    aliases = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("role_id"), F.col("o_orderkey").alias("first_observation_id"))
    events = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("role_id"), F.col("o_orderkey").alias("observation_id"))
    followers = c.select(k.alias("role_id"), F.col("c_nationkey").alias("user_id"))
    split = k % 10 == 0
    splits = c.where(split).select(k.alias("source"), (k + 1_000_000).alias("target"), F.concat(F.lit("Split of "), "c_name").alias("title"), _level(k + 1).alias("level"), F.when(k % 20 == 0, F.concat("c_name", F.lit(" rest"))).alias("source_title"), F.when(k % 40 == 0, "full_time").alias("source_level"))
    moves = o.where((F.col("o_custkey") % 10 == 0) & ((F.col("o_custkey") % 30 == 0) | (F.col("o_orderkey") % 2 == 0))).select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("observation_id"))
    return V.split_roles(splits, moves, roles=roles, matches=matches, aliases=aliases, events=events, followers=followers)


_SPLIT = """o as (select *, o_custkey % 10 = 0 and (o_custkey % 30 = 0 or o_orderkey % 2 = 0) as moves from orders),
    s as (select o_custkey as source, o_custkey + 1000000 as target, count(*) filter (moves) as observations, bool_and(moves) as retired, count(*) filter (moves and o_orderkey % 3 = 0) as aliases, count(*) filter (moves and o_orderstatus = 'F') as events
        from o where o_custkey % 10 = 0 group by 1 having count(*) filter (moves) > 0)"""
_LV = "['internship', 'new_grad', 'apprenticeship', 'unknown'][({} % 4)::int + 1]"
_TR = "case when {0} in ('internship', 'new_grad', 'apprenticeship') then {0} else 'other' end"


@query("role_split", f"with {_SPLIT} select *, case when retired then 1 else 0 end as followers from s")
def role_split(spark, d):
    return _split(spark, d)["audit"]


@query("role_split_roles", f"""with {_SPLIT}, r as (select c.*, s.*, {_LV.format('c_custkey')} as lv from customer c left join s on source = c_custkey)
    select c_custkey as role_id, c_nationkey as company_id, case when not retired and c_custkey % 20 = 0 then c_name || ' rest' else c_name end as title, case when not retired and c_custkey % 40 = 0 then 'full_time' else lv end as level,
        case when not retired and c_custkey % 40 = 0 then 'other' else {_TR.format('lv')} end as track, coalesce(not retired, true) as active, case when retired then target end as superseded_by from r
    union all select target, c_nationkey, 'Split of ' || c_name, {_LV.format('(c_custkey + 1)')}, {_TR.format(_LV.format('(c_custkey + 1)'))}, true, null from r where target is not null""")
def role_split_roles(spark, d):
    return _split(spark, d)["roles"]


@query("role_split_evidence", f"""with {_SPLIT}, t as (select 'matches' as kind, case when moves then o_custkey + 1000000 else o_custkey end as role_id from o union all select 'aliases', case when moves then o_custkey + 1000000 else o_custkey end from o where o_orderkey % 3 = 0
    union all select 'events', case when moves then o_custkey + 1000000 else o_custkey end from o where o_orderstatus = 'F' union all select 'followers', case when retired then target else c_custkey end from customer left join s on source = c_custkey)
    select kind, role_id, count(*) as n from t group by all""")
def role_split_evidence(spark, d):
    tables = _split(spark, d)
    rows = [tables[name].select(F.lit(name).alias("kind"), "role_id") for name in ("matches", "aliases", "events", "followers")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).groupBy("kind", "role_id").agg(F.count(F.lit(1)).alias("n"))


@query("scope_review", """select c_custkey as role_id, case when c_custkey % 6 = 0 then 'in_scope' when c_custkey % 3 = 0 then 'ambiguous' when c_custkey % 3 = 1 then 'in_scope' else 'out_of_scope' end as status, case when c_custkey % 6 = 0 then 'in_scope' else 'rule' end as reason,
    case when c_custkey % 6 = 0 then 'design' end as discipline, case when c_custkey % 6 = 0 then 'internship' end as type, case when c_custkey % 6 = 0 then 'human_review' else 'deterministic' end as method, case when c_custkey % 6 = 0 then 900 else c_custkey % 100 end as classified_at from customer""")
def scope_review(spark, d):
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    c = load(spark, d, "customer")
    roles = c.select(k.alias("role_id"), F.when(k % 3 == 0, "ambiguous").when(k % 3 == 1, "in_scope").otherwise("out_of_scope").alias("status"), F.lit("rule").alias("reason"), none.alias("discipline"), none.alias("type"), F.lit("deterministic").alias("method"), (k % 100).alias("classified_at"))
    asked = c.where(k % 6 == 0).select((k * 7).alias("review_id"), k.alias("role_id"), (k % 100).alias("listed_at"), F.lit("in_scope").alias("status"), F.lit("in_scope").alias("reason"), F.lit("design").alias("discipline"), F.lit("internship").alias("type"), F.lit(900).cast("bigint").alias("decided_at"))
    return V.review_scopes(roles, asked)[0]
