"""Upserts, change feeds and versions on the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import changes as K
from tidewell.registry import query
from tidewell.session import load


def _snapshots(spark, d):
    """Two snapshots of postings: parts below 3/4 of the keys, and parts above 1/4 with every fifth changed."""
    p = load(spark, d, "part")
    seen = lambda day: F.lit(day).cast("date").alias("seen_on")
    row = lambda extra: F.sha2(F.concat_ws("|", "p_name", "p_brand", F.col("p_size").cast("string"), extra), 256).alias("content_hash")
    a = p.where("p_partkey % 4 <> 3").select(F.col("p_partkey").alias("identity"), row(F.lit("")), seen("2024-01-01"))
    b = p.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("identity"), row(F.when(F.pmod("p_partkey", F.lit(5)) == 0, "x").otherwise("")), seen("2024-02-01"))
    return a, b


_SNAP = """a as (select p_partkey as identity, sha256(concat_ws('|', p_name, p_brand, p_size::varchar, '')) as content_hash, date '2024-01-01' as seen_on from part where p_partkey % 4 <> 3),
    b as (select p_partkey as identity, sha256(concat_ws('|', p_name, p_brand, p_size::varchar, case when p_partkey % 5 = 0 then 'x' else '' end)) as content_hash, date '2024-02-01' as seen_on from part where p_partkey % 4 <> 0),
    merged as (select coalesce(a.identity, b.identity) as identity, case when a.identity is null or (b.identity is not null and a.content_hash <> b.content_hash) then b.content_hash else a.content_hash end as content_hash,
    coalesce(a.seen_on, b.seen_on) as first_seen, coalesce(b.seen_on, a.seen_on) as last_seen,
    case when a.identity is null then 'created' when b.identity is null then 'kept' when a.content_hash = b.content_hash then 'unchanged' else 'changed' end as outcome from a full join b on a.identity = b.identity)"""


@query("upsert_outcome", f"with {_SNAP} select * from merged")
def upsert_outcome(spark, d):
    a, b = _snapshots(spark, d)
    return K.upsert(a, b, "identity", "content_hash", "seen_on")


@query("upsert_counts", f"with {_SNAP} select outcome, count(*) as rows from merged group by 1")
def upsert_counts(spark, d):
    a, b = _snapshots(spark, d)
    return K.upsert(a, b, "identity", "content_hash", "seen_on").groupBy("outcome").agg(F.count("*").alias("rows"))


@query("batch_dedupe", "select p_name, p_brand, p_partkey, copies from (select *, row_number() over (partition by p_name order by length(p_brand) desc, p_partkey) as r, count(*) over (partition by p_name) as copies from part) where r = 1")
def batch_dedupe(spark, d):
    p = load(spark, d, "part").select("p_name", "p_brand", "p_partkey")
    return K.longest_per_key(p, "p_name", "p_brand", "p_partkey")


@query("cdc_diff", """with a as (select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders where o_orderkey % 10 <> 9),
    b as (select o_orderkey, case when o_orderkey % 13 = 0 then o_custkey + 1 else o_custkey end as o_custkey, case when o_orderkey % 17 = 0 then 'X' else o_orderstatus end as o_orderstatus, o_totalprice from orders where o_orderkey % 10 <> 0),
    j as (select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, a.o_orderkey is null as ins, b.o_orderkey is null as del, a.o_custkey as ac, b.o_custkey as bc, a.o_orderstatus is distinct from b.o_orderstatus or a.o_totalprice is distinct from b.o_totalprice or a.o_custkey is distinct from b.o_custkey as diff
        from a full join b on a.o_orderkey = b.o_orderkey)
    select o_orderkey, bc as owner, 'inserted' as change from j where ins union all select o_orderkey, ac, 'deleted' from j where del union all
    select o_orderkey, ac, 'moved_out' from j where not ins and not del and ac <> bc union all select o_orderkey, bc, 'moved_in' from j where not ins and not del and ac <> bc union all
    select o_orderkey, bc, 'updated' from j where not ins and not del and ac = bc and diff""")
def cdc_diff(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    after = o.where("o_orderkey % 10 <> 0").withColumns({"o_custkey": F.when(k % 13 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")), "o_orderstatus": F.when(k % 17 == 0, "X").otherwise(F.col("o_orderstatus"))})
    return K.diff(o.where("o_orderkey % 10 <> 9"), after, "o_orderkey", "o_custkey", ["o_custkey", "o_orderstatus", "o_totalprice"])


@query("scd2_versions", """select user_id, version, any_value(event_type) as event_type, min(ts) as valid_from, max(ts) as last_verified, count(*) as confirmations from (
    select *, sum(new) over (partition by user_id order by ts, event_id) as version from (select *, case when event_type is distinct from lag(event_type) over (partition by user_id order by ts, event_id) or row_number() over (partition by user_id order by ts, event_id) = 1 then 1 else 0 end as new from events)) group by user_id, version""")
def scd2_versions(spark, d):
    return K.versions(load(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", "ts", "event_id", "event_type")


@query("material_changes", """with f as (select o_custkey as role_id, o_orderkey as id, o_orderdate as made, round((o_totalprice % 90) * 1.0, 1) as confidence, o_orderdate::date + (o_orderkey % 9)::int as expected_on, o_orderdate::date + (o_orderkey % 9)::int - (o_orderkey % 30)::int as window_start,
        o_orderdate::date + (o_orderkey % 9)::int + (o_orderkey % 30)::int as window_end from orders where o_custkey % 3 = 0 or true),
    d as (select *, round(confidence - lag(confidence) over w, 3) as d_confidence, (expected_on - lag(expected_on) over w)::int as d_date, greatest(abs(window_start - lag(window_start) over w), abs(window_end - lag(window_end) over w))::int as d_bound from f window w as (partition by role_id order by made, id))
    select role_id, id, d_date, d_bound, concat_ws(',', case when abs(d_confidence) >= 1.0 then 'confidence' end, case when abs(d_date) >= 3 then 'date' end, case when d_bound >= 3 then 'interval' end) as reasons from d where abs(d_confidence) >= 1.0 or abs(d_date) >= 3 or d_bound >= 3""".replace(" where o_custkey % 3 = 0 or true", ""))
def material_changes(spark, d):
    o = load(spark, d, "orders")
    k = F.col("o_orderkey")
    on = F.date_add(F.to_date("o_orderdate"), (k % 9).cast("int"))
    f = o.select(F.col("o_custkey").alias("role_id"), k.alias("id"), F.col("o_orderdate").alias("at"), F.round(F.col("o_totalprice") % 90, 1).alias("confidence"), on.alias("expected_on"), F.date_sub(on, (k % 30).cast("int")).alias("window_start"), F.date_add(on, (k % 30).cast("int")).alias("window_end"))
    return K.material_changes(f, "role_id", "at", "id").select("role_id", "id", "d_date", "d_bound", "reasons")


@query("evidence_weights", """select o_orderkey as forecast_id, unnest(ids) as evidence_id, round(least(1.0, greatest(0.0, (w / len(ids)))), 6) as weight from (select l_orderkey as o_orderkey, list(l_linenumber order by l_linenumber) as ids, sum(l_discount) * 10 as w from lineitem group by 1)""")
def evidence_weights(spark, d):
    g = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("forecast_id")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("ids"), (F.sum("l_discount") * 10).alias("w"))
    return K.evidence_rows(g, "forecast_id", "ids", "w")


@query("held_state", """select user_id, case when max((action = 'withdraw')::int) = 1 then 'withdrawn' when max(case when r = 1 then action end) = 'disable' then 'held' else 'active' end as state from (
    select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from (select *, case when value > 299 then 'withdraw' when event_id % 3 = 0 then 'enable' else 'disable' end as action from events)) group by 1""")
def held_state(spark, d):
    e = load(spark, d, "events")
    action = F.when(F.col("value") > 299, "withdraw").when(F.pmod("event_id", F.lit(3)) == 0, "enable").otherwise("disable")
    return K.held_state(e.withColumn("action", action), "user_id", "ts", "event_id", "action")


@query("new_items_since_baseline", "select l_suppkey as source_id, l_partkey as item, min(l_shipdate) as first_at from lineitem group by 1, 2 having min(l_shipdate) >= timestamp '2000-06-01'")
def new_items_since_baseline(spark, d):
    li = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("item"), "l_shipdate")
    return K.new_items(li, F.lit("2000-06-01").cast("timestamp"), "source_id", "item", "l_shipdate")


@query("trimmed_texts", "select doc_id, case when lang <> 'en' and length(text) > 100 then left(text, 100) else text end as text from documents")
def trimmed_texts(spark, d):
    return K.trim(load(spark, d, "documents").select("doc_id", "text", "lang"), "text", 100, F.col("lang") != "en").select("doc_id", "text")


@query("changed_role_feed", """select distinct role_id from (select o_custkey as role_id from orders where o_orderdate >= timestamp '2001-05-01' union select user_id from events where ts >= timestamp '2024-01-25' union
    select o_custkey from lineitem join orders on o_orderkey = l_orderkey where l_shipdate >= timestamp '2001-10-01')""")
def changed_role_feed(spark, d):
    o, e, li = load(spark, d, "orders"), load(spark, d, "events"), load(spark, d, "lineitem")
    late = li.where(F.col("l_shipdate") >= F.lit("2001-10-01").cast("timestamp")).select("l_orderkey")
    a = o.where(F.col("o_orderdate") >= F.lit("2001-05-01").cast("timestamp")).select(F.col("o_custkey").alias("role_id"))
    b = e.where(F.col("ts") >= F.lit("2024-01-25").cast("timestamp")).select(F.col("user_id").alias("role_id"))
    c = o.join(late, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select(F.col("o_custkey").alias("role_id"))
    return a.union(b).union(c).distinct()


@query("json_recordset_update", """select c_custkey, coalesce((select max((props->>'$.k')::int) from events where user_id = c_custkey), -1)::int as k from customer""")
def json_recordset_update(spark, d):
    e = load(spark, d, "events").select("user_id", F.from_json("props", "k int").alias("r")).groupBy("user_id").agg(F.max("r.k").alias("k"))
    return load(spark, d, "customer").join(e, F.col("user_id") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("k", F.lit(-1)).alias("k"))
