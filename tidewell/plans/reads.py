"""Composite reads: provenance, histories, feeds, plans, calendars and digests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell import standins as S
from tidewell.operators import readiness as R
from tidewell.operators import sequences as Q
from tidewell.registry import query
from tidewell.session import load


@query("provenance_star", """select l_orderkey, l_linenumber, c_name, n_name, s_name, p_name, e.event_type from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join supplier on s_suppkey = l_suppkey
    left join (select * from part where p_size > 25) p on p_partkey = l_partkey left join (select * from events where event_type = 'purchase') e on e.event_id = l_orderkey where l_shipdate >= timestamp '2001-01-01'""")
def provenance_star(spark, d):
    li = load(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("2001-01-01").cast("timestamp")).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    o, c, n, s = (load(spark, d, t) for t in ("orders", "customer", "nation", "supplier"))
    p = load(spark, d, "part").where("p_size > 25").select("p_partkey", "p_name")
    e = load(spark, d, "events").where("event_type = 'purchase'").select("event_id", "event_type")
    j = (
        li.join(o.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey")).join(c.select("c_custkey", "c_name", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
        .join(n.select("n_nationkey", "n_name"), F.col("n_nationkey") == F.col("c_nationkey")).join(s.select("s_suppkey", "s_name"), F.col("s_suppkey") == F.col("l_suppkey"))
        .join(p, F.col("p_partkey") == F.col("l_partkey"), "left").join(e, F.col("event_id") == F.col("l_orderkey"), "left")
    )
    return j.select("l_orderkey", "l_linenumber", "c_name", "n_name", "s_name", "p_name", "event_type")


_CAPTURES = """captures as (select user_id, ts::date as day, min(case event_type when 'error' then 'unknown' when 'view' then 'absent' when 'click' then 'absent' else 'present' end) as state from events group by 1, 2),
    told as (select *, lag(state) over w as prev, lag(day) over w as prev_day, min(case when state = 'absent' then day end) over (partition by user_id order by day rows between 1 following and unbounded following) as closed_on from captures where state <> 'unknown' window w as (partition by user_id order by day)),
    opened as (select *, case when prev = 'absent' then prev_day + 1 end as earliest from told where state = 'present' and (prev is null or prev = 'absent')),
    openings0 as (select user_id, case when day - earliest between 0 and 120 then earliest + ((day - earliest) // 2)::int else day end as opened_on, case when day - earliest between 0 and 120 then 'bounded' else 'observed_by' end as precision,
    case when day - earliest between 0 and 120 then earliest end as window_start, case when day - earliest between 0 and 120 then day end as window_end, closed_on from opened)"""


def _captures(spark, d):
    e = load(spark, d, "events")
    state = F.when(F.col("event_type") == "error", "unknown").when(F.col("event_type").isin("view", "click"), "absent").otherwise("present")
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min(state).alias("state"))


@query("visibility_history", f"with {_CAPTURES} select * from openings0")
def visibility_history(spark, d):
    return Q.visibility_openings(_captures(spark, d), ["user_id"], "day", "state")


@query("merged_history", f"""with recursive {_CAPTURES}, c as (select user_id, opened_on as d, case precision when 'bounded' then 1 else 0 end as p, window_start as s, window_end as e, row_number() over (partition by user_id order by opened_on, case precision when 'bounded' then 1 else 0 end, window_start nulls first, window_end nulls first) as i from openings0),
    f as (select user_id, i, d, p, s, e, 1 as n, 1 as g from c where i = 1 union all
    select c.user_id, c.i, case when j then (case when c.p > f.p then c.d else f.d end) else c.d end, case when j then greatest(c.p, f.p) else c.p end,
        case when not j or c.p > f.p then c.s when c.p = 1 and f.p = 1 then (case when greatest(c.s, f.s) <= least(c.e, f.e) then greatest(c.s, f.s) else least(c.s, f.s) end) else f.s end,
        case when not j or c.p > f.p then c.e when c.p = 1 and f.p = 1 then (case when greatest(c.s, f.s) <= least(c.e, f.e) then least(c.e, f.e) else greatest(c.e, f.e) end) else f.e end,
        case when j then f.n + 1 else 1 end, case when j then f.g else f.g + 1 end
    from f join c on c.user_id = f.user_id and c.i = f.i + 1, lateral (select abs(c.d - f.d) <= 75 and year(c.d) = year(f.d) as j))
    select user_id, d as opened_on, p as rank, s as window_start, e as window_end, n as merged from (select *, row_number() over (partition by user_id, g order by i desc) as r from f) where r = 1""")
def merged_history(spark, d):
    h = Q.visibility_openings(_captures(spark, d), ["user_id"], "day", "state").withColumn("rank", F.when(F.col("precision") == "bounded", 1).otherwise(0))
    return Q.merge_candidates(h, "user_id", "opened_on", "rank", "window_start", "window_end")


@query("capture_changes", """select event_id, case when r = 1 then 'first_observed' when h is not distinct from p then 'unchanged' else 'meaningful_change' end as change_kind from (select event_id, event_type as h, lag(event_type) over w as p, row_number() over w as r from events where value < 60 window w as (partition by user_id order by ts, event_id))""")
def capture_changes(spark, d):
    return Q.change_kind(load(spark, d, "events"), ["user_id"], "ts", "event_id", "event_type", F.col("value") < 60).select("event_id", "change_kind")


@query("month_bands", """select o_custkey, band, band_key, count(*) as rows from (select *, sum(n) over (partition by o_custkey order by o_orderdate, o_orderkey) as band from (
    select *, strftime(o_orderdate, '%Y-%m') as band_key, case when strftime(o_orderdate, '%Y-%m') is not distinct from lag(strftime(o_orderdate, '%Y-%m')) over (partition by o_custkey order by o_orderdate, o_orderkey) then 0 else 1 end as n from orders)) group by all""")
def month_bands(spark, d):
    b = Q.bands(load(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), [F.col("o_orderdate"), F.col("o_orderkey")], F.date_format("o_orderdate", "yyyy-MM"), ["o_custkey"])
    return b.groupBy("o_custkey", "band", "band_key").agg(F.count("*").alias("rows"))


@query("interleaved_feed")
def interleaved_feed(spark, d):
    o = S.openings(spark, d).join(S.roles(spark, d).select("role_id", "company_id"), "role_id").where("precision = 'exact'").select("event_id", "company_id", "opened_on")
    newest = [F.col("opened_on").desc(), F.col("event_id")]
    last = load(spark, d, "orders").agg(F.to_date(F.max("o_orderdate")).alias("last"))
    return Q.interleave(o.where(F.col("opened_on") >= F.date_sub(last.scalar(), 45)), "company_id", newest)


@query("interleave_check", "select 0::bigint as violations")
def interleave_check(spark, d):
    """Windows over the woven feed in which a company would break the rule: none."""
    w = Window.orderBy("place")
    f = interleaved_feed(spark, d).where("place is not null")
    seen = F.collect_list("company_id").over(w.rowsBetween(-Q.FEED_SPAN, -1))
    return f.withColumn("same", F.size(F.filter(seen, lambda c: c == F.col("company_id")))).agg(F.count_if(F.col("same") >= Q.FEED_MOST).alias("violations"))


@query("just_opened", """select event_id, role_id, opened_on from (select o_orderkey as event_id, o_custkey as role_id, o_orderdate::date as opened_on from orders where o_orderstatus = 'F') where opened_on >= (select max(o_orderdate)::date from orders) - 45""")
def just_opened(spark, d):
    o = S.openings(spark, d).where("precision = 'exact'").select("event_id", "role_id", "opened_on")
    last = load(spark, d, "orders").agg(F.to_date(F.max("o_orderdate")).alias("last"))
    return o.where(F.col("opened_on") >= F.date_sub(last.scalar(), 45))


@query("rate_windows", "select event_id, count(*) over (partition by user_id order by epoch(ts)::bigint range between 3599 preceding and current row) as in_period, count(*) over (partition by user_id order by epoch(ts)::bigint range between 3599 preceding and current row) <= 2 as allowed from (select *, epoch_us(ts) // 1000000 as s from events)".replace("epoch(ts)::bigint", "s"))
def rate_windows(spark, d):
    e = load(spark, d, "events").withColumn("s", F.unix_timestamp("ts"))
    return Q.sliding_limit(e, "user_id", F.col("s"), 3600, 2).select("event_id", "in_period", "allowed")


@query("even_sample", "select o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as i, count(*) over (partition by o_custkey) as n from orders) where n <= 4 or i = 0 or floor(i * 4 / n::double) <> floor((i - 1) * 4 / n::double)")
def even_sample(spark, d):
    o = load(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return Q.systematic_sample(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], 4).select("o_orderkey")


_SIZES = "['startup','small','medium','large','enterprise']"
_PLAN = f"""f as (select o_orderkey as forecast_id, o_orderdate::date - (o_orderkey % 30)::int as window_start, o_orderdate::date + (o_orderkey % 30)::int as window_end, {_SIZES}[(o_custkey % 5)::int + 1] as size, (o_custkey % 10) / 10.0::double as scale, (o_orderkey % 8) / 8.0::double as competitiveness, (o_orderkey % 97)::double as confidence, o_orderkey % 3 = 0 as portfolio from orders),
    l as (select * from f, (select unnest([{{'action': 'networking', 'base': 63, 'least': 28}}, {{'action': 'referral', 'base': 49, 'least': 21}}, {{'action': 'portfolio', 'base': 35, 'least': 14}}, {{'action': 'resume', 'base': 28, 'least': 14}}, {{'action': 'high_alert', 'base': 7, 'least': 3}}], recursive := true)) where window_end >= date '2000-06-01' and (action <> 'portfolio' or portfolio)),
    t as (select *, greatest(least, base + least(35, greatest(-10, [-7, -3, 0, 5, 9][list_position({_SIZES}, size)] + round_even((scale - 0.5) * 14, 0) + round_even((competitiveness - 0.5) * 18, 0) + least(18, ceil(greatest(0, window_end - window_start - 14) / 7.0) * 3) + least(16, ceil(greatest(0, 70 - confidence) / 5) * 2)))::int) as lead_days from l),
    plan as (select forecast_id, action, lead_days, greatest(window_start - lead_days, date '2000-06-01') as due_on, window_start - lead_days < date '2000-06-01' as overdue from t)"""


def _plan(spark, d):
    o = load(spark, d, "orders")
    k, on = F.col("o_orderkey"), F.to_date("o_orderdate")
    size = F.element_at(F.array(*map(F.lit, ("startup", "small", "medium", "large", "enterprise"))), F.pmod("o_custkey", F.lit(5)).cast("int") + 1)
    f = o.select(
        k.alias("forecast_id"), F.date_sub(on, (k % 30).cast("int")).alias("window_start"), F.date_add(on, (k % 30).cast("int")).alias("window_end"), size.alias("size"), (F.col("o_custkey") % 10 / 10.0).alias("scale"),
        (k % 8 / 8.0).alias("competitiveness"), (k % 97).cast("double").alias("confidence"), (k % 3 == 0).alias("portfolio"),
    )
    return R.plan(f, F.lit("2000-06-01").cast("date"), F.col("portfolio"))


@query("readiness_plan", f"with {_PLAN} select * from plan")
def readiness_plan(spark, d):
    return _plan(spark, d)


@query("prepare_now", f"with {_PLAN} select action, count(*) as due, min(due_on) as first_due from plan where due_on between date '2000-05-18' and date '2000-07-01' group by 1")
def prepare_now(spark, d):
    p = _plan(spark, d).where(F.col("due_on").between(F.lit("2000-05-18").cast("date"), F.lit("2000-07-01").cast("date")))
    return p.groupBy("action").agg(F.count("*").alias("due"), F.min("due_on").alias("first_due"))


@query("digest_union", f"""with {_PLAN} select kind, event_on, item, sha256(kind || '|' || event_on || '|' || item) as fingerprint from (
    select 'opening' as kind, o_orderdate::date as event_on, o_orderkey as item from orders where o_orderstatus = 'F' and o_orderdate >= timestamp '2000-05-25' and o_orderdate <= timestamp '2000-06-01' union all
    select 'window', o_orderdate::date, o_orderkey from orders where o_orderstatus = 'O' and o_orderdate > timestamp '2000-06-01' and o_orderdate <= timestamp '2000-07-01' union all
    select 'deadline', due_on, forecast_id from plan where action = 'resume' and not overdue and due_on <= date '2000-06-15')""")
def digest_union(spark, d):
    o, day = S.openings(spark, d), lambda s: F.lit(s).cast("date")
    row = lambda df, kind, on, item: df.select(F.lit(kind).alias("kind"), F.col(on).alias("event_on"), F.col(item).alias("item"))
    u = row(o.where((F.col("precision") == "exact") & F.col("opened_on").between(day("2000-05-25"), day("2000-06-01"))), "opening", "opened_on", "event_id")
    u = u.unionByName(row(o.where((F.col("precision") == "bounded") & (F.col("opened_on") > day("2000-06-01")) & (F.col("opened_on") <= day("2000-07-01"))), "window", "opened_on", "event_id"))
    u = u.unionByName(row(_plan(spark, d).where((F.col("action") == "resume") & ~F.col("overdue") & (F.col("due_on") <= day("2000-06-15"))), "deadline", "due_on", "forecast_id"))
    return u.withColumn("fingerprint", F.sha2(F.concat_ws("|", "kind", F.col("event_on").cast("string"), F.col("item").cast("string")), 256))


@query("calendar_union", """select month, kind, count(*) as entries from (select strftime(o_orderdate, '%Y-%m') as month, 'opened' as kind from orders where o_orderstatus = 'F' union all select strftime(o_orderdate + interval 30 day, '%Y-%m'), 'window_end' from orders where o_orderstatus = 'O' union all
    select strftime(l_shipdate, '%Y-%m'), 'closed' from lineitem where l_returnflag = 'R') group by all""")
def calendar_union(spark, d):
    o = S.openings(spark, d)
    month = lambda c: F.date_format(c, "yyyy-MM").alias("month")
    a = o.where("precision = 'exact'").select(month(F.col("opened_on")), F.lit("opened").alias("kind"))
    b = o.where("precision = 'bounded'").select(month(F.date_add("opened_on", 30)), F.lit("window_end").alias("kind"))
    c = load(spark, d, "lineitem").where("l_returnflag = 'R'").select(month(F.col("l_shipdate")), F.lit("closed").alias("kind"))
    # Each part is counted before the union, so months travel, not rows.
    counted = [x.groupBy("month", "kind").agg(F.count("*").alias("entries")) for x in (a, b, c)]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("replay_candidates", """select r.role_id, t.event_id, t.opened_on, case when t.event_id % 5 = 0 then 'not_in_run' when t.event_id % 7 = 0 then 'skipped' when exists (select 1 from orders x where x.o_custkey = r.role_id and year(x.o_orderdate) = year(t.opened_on) and x.o_orderkey % 2 = 0 and x.o_orderkey <> t.event_id) then 'other_event' else 'scored' end as outcome
    from (select c_custkey as role_id from customer) r join (select *, row_number() over (partition by role_id order by opened_on desc, event_id) as n from (select o_custkey as role_id, o_orderkey as event_id, o_orderdate::date as opened_on from orders where o_orderstatus in ('F', 'O'))) t on t.role_id = r.role_id and n = 1
    where (select count(*) from orders where o_custkey = r.role_id) >= 2""")
def replay_candidates(spark, d):
    o = S.openings(spark, d)
    enough = o.groupBy("role_id").agg(F.count("*").alias("_n")).where("_n >= 2").select("role_id")
    w = Window.partitionBy("role_id").orderBy(F.col("opened_on").desc(), "event_id")
    t = o.where("precision in ('exact', 'bounded')").withColumn("_r", F.row_number().over(w)).where("_r = 1").join(enough, "role_id", "left_semi").select("role_id", "event_id", "opened_on", F.year("opened_on").alias("y"))
    even = o.where("event_id % 2 = 0").groupBy("role_id", F.year("opened_on").alias("y")).agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    j = t.join(even, ["role_id", "y"], "left")
    other = F.coalesce((F.col("lo") != F.col("event_id")) | (F.col("hi") != F.col("event_id")), F.lit(False))
    outcome = F.when(F.col("event_id") % 5 == 0, "not_in_run").when(F.col("event_id") % 7 == 0, "skipped").when(other, "other_event").otherwise("scored")
    return j.select("role_id", "event_id", "opened_on", outcome.alias("outcome"))


@query("conversation_turns", "select conv_id, turn, role, coalesce(role <> lag(role) over (partition by conv_id order by turn, role), true) as speaker_change, length(text) as n_chars from conversations")
def conversation_turns(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    return load(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce(F.col("role") != F.lag("role").over(w), F.lit(True)).alias("speaker_change"), F.char_length("text").alias("n_chars"))
