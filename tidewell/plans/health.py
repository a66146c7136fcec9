"""Collection-health queries on the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell import standins as S
from tidewell.operators import health as H
from tidewell.registry import query
from tidewell.session import load


@query("failure_streak", """select user_id, coalesce(min(case when event_type <> 'error' then r end) - 1, count(*))::bigint as streak, max(case when r = 1 then event_type end) as latest, max(ts) as latest_at
    from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) group by 1""")
def failure_streak(spark, d):
    return H.failure_streak(load(spark, d, "events"), ["user_id"], "ts", "event_id", F.col("event_type") == "error", "event_type")


@query("refusal_streak", """select user_id, coalesce(min(case when not refused then r end) - 1, count(*))::bigint as streak, max(case when r = 1 then props end) as latest, max(ts) as latest_at
    from (select *, (props->>'$.k')::int >= 50 as refused, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) group by 1""")
def refusal_streak(spark, d):
    code = F.get_json_object("props", "$.k").cast("int")
    return H.failure_streak(load(spark, d, "events"), ["user_id"], "ts", "event_id", code >= 50, "props")


@query("source_yield", """select s_suppkey as source_id, n_name as company, coalesce(f.fetches, 0) as fetches, coalesce(f.jobs, 0) as jobs, f.last_at, c.newest_order from supplier join nation on n_nationkey = s_nationkey
    left join (select l_suppkey, count(*) as fetches, count(distinct l_partkey) as jobs, max(l_shipdate) as last_at from lineitem where l_returnflag <> 'R' group by 1) f on f.l_suppkey = s_suppkey
    left join (select l_suppkey, l_orderkey as newest_order from (select *, row_number() over (partition by l_suppkey order by l_shipdate desc, l_orderkey, l_linenumber) as r from lineitem) where r = 1) c on c.l_suppkey = s_suppkey""")
def source_yield(spark, d):
    from pyspark.sql import Window

    li = load(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag")
    fetched = li.where("l_returnflag <> 'R'").groupBy("l_suppkey").agg(F.count("*").alias("fetches"), F.countDistinct("l_partkey").alias("jobs"), F.max("l_shipdate").alias("last_at"))
    newest = Window.partitionBy("l_suppkey").orderBy(F.col("l_shipdate").desc(), "l_orderkey", "l_linenumber")
    call = li.withColumn("_r", F.row_number().over(newest)).where("_r = 1").select("l_suppkey", F.col("l_orderkey").alias("newest_order"))
    s = load(spark, d, "supplier").join(S.companies(spark, d), F.col("company_id") == F.col("s_nationkey"))
    j = s.join(fetched, F.col("s_suppkey") == fetched.l_suppkey, "left").drop("l_suppkey").join(call, F.col("s_suppkey") == call.l_suppkey, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select(F.col("s_suppkey").alias("source_id"), "company", zero("fetches"), zero("jobs"), "last_at", "newest_order")


@query("dead_sources", """select l_suppkey as source_id, count(*) as fetches from lineitem group by 1 having count(*) >= 50 and count(*) filter (l_linestatus = 'F' and l_quantity > 49) = 0""")
def dead_sources(spark, d):
    li = load(spark, d, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("source_id")).agg(F.count("*").alias("fetches"), F.count_if((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 49)).alias("_j")).where("fetches >= 50 and _j = 0").drop("_j")


def _daily(spark, d):
    return H.daily_rows({"orders": (load(spark, d, "orders"), "o_orderdate"), "lineitem": (load(spark, d, "lineitem"), "l_shipdate"), "events": (load(spark, d, "events"), "ts")})


_DAILY = """select 'orders' as table_name, o_orderdate::date as day, count(*) as rows from orders group by 2 union all
    select 'lineitem', l_shipdate::date, count(*) from lineitem group by 2 union all select 'events', ts::date, count(*) from events group by 2"""


@query("daily_rows", _DAILY)
def daily_rows(spark, d):
    return _daily(spark, d)


@query("growth_active_days", f"with daily as ({_DAILY}) select table_name, count(*) as active_days, round(avg(rows), 3) as rows_per_day from (select *, min(day) over (partition by table_name) as lo, max(day) over (partition by table_name) as hi from daily) where day > lo and day < hi group by 1")
def growth_active_days(spark, d):
    return H.growth(_daily(spark, d))


@query("table_totals", " union all ".join(f"select '{t}' as table_name, count(*) as rows from {t}" for t in ("customer", "orders", "lineitem", "part", "supplier", "events")))
def table_totals(spark, d):
    return H.totals({t: load(spark, d, t) for t in ("customer", "orders", "lineitem", "part", "supplier", "events")})


@query("ordered_fingerprint", "select o_custkey, md5(string_agg(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority, ',' order by o_orderkey)) as fingerprint from orders group by 1")
def ordered_fingerprint(spark, d):
    return H.ordered_fingerprint(load(spark, d, "orders"), "o_custkey", "o_orderkey", ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query("fetch_ages", """select count(*) filter (last_at is null) as never, count(*) filter (last_at < date '2001-10-01') as stale, min(last_at)::date as oldest, arg_min(s_suppkey, struct_pack(a := last_at, b := s_suppkey)) filter (last_at is not null) as oldest_source
    from supplier left join (select l_suppkey, max(l_shipdate) as last_at from lineitem group by 1) on l_suppkey = s_suppkey""")
def fetch_ages(spark, d):
    last = load(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max("l_shipdate").alias("last_at"))
    j = load(spark, d, "supplier").join(last, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return j.agg(
        F.count_if(F.col("last_at").isNull()).alias("never"), F.count_if(F.col("last_at") < F.lit("2001-10-01").cast("date")).alias("stale"), F.to_date(F.min("last_at")).alias("oldest"),
        F.min_by("s_suppkey", F.when(F.col("last_at").isNotNull(), F.struct("last_at", "s_suppkey"))).alias("oldest_source"),
    )


@query("decision_metrics", """select user_id % 20 as run, count(*) as pages, count(*) filter (event_type <> 'view') as changed, count(*) filter (event_type <> 'view' and not value > 50) as deterministic,
    count(*) filter (event_type <> 'view' and value > 50) as escalations, round(100 * (count(*) filter (event_type <> 'view' and not value > 50))::double / nullif(count(*) filter (event_type <> 'view'), 0), 2) as deterministic_percent from events group by 1""")
def decision_metrics(spark, d):
    e = load(spark, d, "events").withColumn("run", F.pmod("user_id", F.lit(20)))
    return H.decision_metrics(e, "run", F.col("event_type") != "view", F.col("value") > 50)


@query("integrity_audit", """select 'orphan_orders' as check_name, count(*) as violations from orders where not exists (select 1 from customer where c_custkey = o_custkey) union all
    select 'orphan_lines', count(*) from lineitem where not exists (select 1 from orders where o_orderkey = l_orderkey) union all
    select 'discount_range', count(*) from lineitem where not (l_discount between 0 and 1) union all
    select 'repeated_line_key', count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1) union all
    select 'negative_balance', count(*) from customer where c_acctbal < 0""")
def integrity_audit(spark, d):
    o, li, c = load(spark, d, "orders"), load(spark, d, "lineitem"), load(spark, d, "customer")
    return H.violations({
        "orphan_orders": o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti"), "orphan_lines": li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"),
        "discount_range": li.where(~F.col("l_discount").between(0, 1)), "repeated_line_key": li.groupBy("l_orderkey", "l_linenumber").count().where("count > 1"), "negative_balance": c.where("c_acctbal < 0"),
    })


@query("latest_fetch", "select l_suppkey as source_id, l_orderkey as fetch_id, l_linenumber as part, l_shipdate as fetched_at from (select *, row_number() over (partition by l_suppkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc) as r from lineitem) where r = 1")
def latest_fetch(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey").orderBy(F.col("l_shipdate").desc(), F.col("l_orderkey").desc(), F.col("l_linenumber").desc())
    li = load(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate")
    return li.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(F.col("l_suppkey").alias("source_id"), F.col("l_orderkey").alias("fetch_id"), F.col("l_linenumber").alias("part"), F.col("l_shipdate").alias("fetched_at"))


@query("rotation_order", "select s_suppkey as source_id, last_at from supplier left join (select l_suppkey, max(l_shipdate) as last_at from lineitem where l_quantity > 45 group by 1) on l_suppkey = s_suppkey order by last_at asc nulls first, s_suppkey limit 15")
def rotation_order(spark, d):
    last = load(spark, d, "lineitem").where("l_quantity > 45").groupBy("l_suppkey").agg(F.max("l_shipdate").alias("last_at"))
    j = load(spark, d, "supplier").join(last, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return j.select(F.col("s_suppkey").alias("source_id"), "last_at").orderBy(F.col("last_at").asc_nulls_first(), "source_id").limit(15)
