"""Forecast versions and changes, portfolio answers, signals and captures, on the supplied tables.

forecast = order, role = customer, refusal = error event, watchlist = customers with a balance above zero."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import lineage as L
from tidewell.registry import query
from tidewell.session import load

AS_OF, HORIZON = "2001-07-15", 90
_V = """v as (select o_orderkey as forecast_id, o_custkey as role_id, o_orderdate::date as forecasted_on, o_orderdate::date + (60 + o_orderkey % 3)::int as window_start,
        o_orderdate::date + (80 + o_orderkey % 5)::int as window_end, (o_orderkey * 7 % 100)::int as confidence,
        case when o_orderkey * 7 % 100 < 40 then 'low' when o_orderkey * 7 % 100 < 70 then 'medium' else 'high' end as word,
        case when o_orderstatus = 'F' then o_orderdate::date + 30 end as verified_on, o_orderpriority as track from orders)"""
_C = f"""{_V}, c as (select * from (select role_id, lag(forecast_id) over w as before_id, forecast_id as after_id, forecasted_on as changed_on from v window w as (partition by role_id order by forecasted_on, forecast_id)) where before_id is not null),
    l as (select c.*, (a.window_start - b.window_start)::int as start_delta, (a.window_end - b.window_end)::int as end_delta, a.window_start <> b.window_start or a.window_end <> b.window_end or a.word <> b.word as felt
        from c join v b on b.forecast_id = before_id join v a on a.forecast_id = after_id)"""
_CUR = f"""{_V}, latest as (select * from v qualify row_number() over (partition by role_id order by forecasted_on desc, forecast_id desc) = 1),
    refused as (select user_id as role_id, max(ts)::date - 9500 as refused_on from events where event_type = 'error' group by 1),
    cur as (select latest.*, date '{AS_OF}' - coalesce(verified_on, forecasted_on) > 7 as stale from latest left join refused using (role_id) where refused_on is null or forecasted_on > refused_on)"""


def _versions(spark, d):
    k, on = F.col("o_orderkey"), F.to_date("o_orderdate")
    c = k * 7 % 100
    return load(spark, d, "orders").select(
        k.alias("forecast_id"), F.col("o_custkey").alias("role_id"), on.alias("forecasted_on"), F.date_add(on, (k % 3 + 60).cast("int")).alias("window_start"), F.date_add(on, (k % 5 + 80).cast("int")).alias("window_end"),
        c.cast("int").alias("confidence"), F.when(c < 40, "low").when(c < 70, "medium").otherwise("high").alias("word"), F.when(F.col("o_orderstatus") == "F", F.date_add(on, 30)).alias("verified_on"), F.col("o_orderpriority").alias("track"),
    )


def _lineage(spark, d):
    v = _versions(spark, d)
    return L.lineage(L.changes(v), v)


def _latest(spark, d):
    return L.newest(_versions(spark, d), "role_id", F.col("forecasted_on").desc(), F.col("forecast_id").desc()).drop("_r")


def _current(spark, d):
    refused = load(spark, d, "events").where("event_type = 'error'").groupBy(F.col("user_id").alias("role_id")).agg(F.date_sub(F.to_date(F.max("ts")), 9500).alias("refused_on"))
    return L.current(_latest(spark, d), refused, F.to_date(F.lit(AS_OF)))


@query("change_lineage", f"with {_C} select * from l")
def change_lineage(spark, d):
    return _lineage(spark, d)


@query("watched_changes", f"""with {_C} select role_id, after_id, changed_on, start_delta, end_delta from (select l.*, row_number() over (partition by role_id order by changed_on desc, after_id desc) as r from l join customer on c_custkey = role_id and c_acctbal > 0
    where felt and changed_on between date '{AS_OF}' - 7 and date '{AS_OF}') where r = 1 order by changed_on desc, after_id desc limit {L.NEWEST}""")
def watched_changes(spark, d):
    """The newest felt change of each watched role in seven days, the six newest."""
    watched = load(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("role_id"))
    end = F.to_date(F.lit(AS_OF))
    # Only changes of the seven days are joined with their forecasts.
    v = _versions(spark, d)
    recent = L.changes(v).where(F.col("changed_on").between(F.date_sub(end, 7), end)).join(watched, "role_id", "left_semi")
    order = F.col("changed_on").desc(), F.col("after_id").desc()
    return L.newest(L.lineage(recent, v).where("felt"), "role_id", *order).orderBy(*order).limit(L.NEWEST).select("role_id", "after_id", "changed_on", "start_delta", "end_delta")


@query("version_notes", f"""with {_C} select v.role_id, v.forecast_id, r as version, l.start_delta, l.felt from (select *, row_number() over (partition by role_id order by forecasted_on desc, forecast_id desc) as r from v) v
    left join l on l.after_id = v.forecast_id where r <= {L.VERSIONS}""")
def version_notes(spark, d):
    v = _versions(spark, d)
    top = L.newest(v, "role_id", F.col("forecasted_on").desc(), F.col("forecast_id").desc(), n=L.VERSIONS).select("role_id", "forecast_id", F.col("_r").alias("version"))
    note = _lineage(spark, d).select(F.col("after_id").alias("forecast_id"), "start_delta", "felt")
    return top.join(note, "forecast_id", "left").select("role_id", "forecast_id", "version", "start_delta", "felt")


@query("change_triggers", f"""with {_C}, last as (select * from c qualify row_number() over (partition by role_id order by changed_on desc, after_id desc) = 1)
    select last.role_id, after_id, event_id as signal_id, event_type as kind from last join v b on b.forecast_id = before_id join events on user_id = last.role_id and ts::date - 9510 > b.forecasted_on and ts::date - 9510 <= changed_on""")
def change_triggers(spark, d):
    """The signals seen between the two forecasts of a role's latest change."""
    v = _versions(spark, d)
    last = L.newest(L.changes(v), "role_id", F.col("changed_on").desc(), F.col("after_id").desc())
    since = v.select(F.col("forecast_id").alias("before_id"), F.col("forecasted_on").alias("since"))
    e = load(spark, d, "events").select(F.col("user_id").alias("role_id"), F.col("event_id").alias("signal_id"), F.col("event_type").alias("kind"), F.date_sub(F.to_date("ts"), 9510).alias("seen"))
    return last.join(since, "before_id").join(e, "role_id").where("seen > since and seen <= changed_on").select("role_id", "after_id", "signal_id", "kind")


@query("current_forecasts", f"with {_CUR} select role_id, forecast_id, stale from cur")
def current_forecasts(spark, d):
    return _current(spark, d).select("role_id", "forecast_id", "stale")


@query("upcoming_openings", f"""with {_CUR} select role_id, forecast_id, window_start, confidence from cur
    where not stale and window_start <= date '{AS_OF}' + {HORIZON} and window_end >= date '{AS_OF}' and track <> '5-LOW'""")
def upcoming_openings(spark, d):
    as_of = F.to_date(F.lit(AS_OF))
    live = _current(spark, d).where(~F.col("stale") & (F.col("window_start") <= F.date_add(as_of, HORIZON)) & (F.col("window_end") >= as_of) & (F.col("track") != "5-LOW"))
    return live.select("role_id", "forecast_id", "window_start", "confidence").orderBy("window_start", F.col("confidence").desc(), "role_id")


_FACTORS = {"role_history_strength": 11, "prior_support": 13, "cycle_consistency": 17, "source_quality": 19, "signal_contradiction": 23, "signal_conflict": 29}


@query("confidence_explanation", f"""with {_V}, f as (select forecast_id, role_id, unnest([{", ".join(f"{{'name': '{n}', 'value': (forecast_id * {m} % 101) / 100.0::double}}" for n, m in _FACTORS.items())}], recursive := true) from v),
    e as (select *, case when name in ('signal_contradiction', 'signal_conflict') then case when value <= 0.25 then 'supports' when value > 0.45 then 'limits' else 'neutral' end
        when value < 0.55 then 'limits' when value >= 0.75 then 'supports' else 'neutral' end as effect from f)
    select forecast_id, count(*) filter (effect = 'supports') as supports, count(*) filter (effect = 'neutral') as neutral, coalesce(array_to_string((list(name order by value, name) filter (effect = 'limits'))[:3], ', '), '') as limiting from e group by 1""")
def confidence_explanation(spark, d):
    """What supports and what limits each forecast; the three lowest limiting factors by name."""
    v = F.col("forecast_id")
    facts = F.array(*[F.struct(((v * m % 101) / 100.0).alias("value"), F.lit(n).alias("name")) for n, m in _FACTORS.items()])
    with_effect = F.transform(facts, lambda x: F.struct(x["value"].alias("value"), x["name"].alias("name"), L.effect(x["name"], x["value"]).alias("effect")))
    of = lambda kind: F.filter("f", lambda x: x["effect"] == kind)
    names = F.transform(F.slice(F.array_sort(of("limits")), 1, 3), lambda x: x["name"])
    return _versions(spark, d).select("forecast_id", with_effect.alias("f")).select("forecast_id", F.size(of("supports")).cast("bigint").alias("supports"), F.size(of("neutral")).cast("bigint").alias("neutral"), F.array_join(names, ", ").alias("limiting"))


_EV = """ev as (select p.p_partkey as evidence_id, p.p_brand as company, list_distinct(string_split(p.p_name || ' ' || coalesce(q.p_name, ''), ' ')) as words from part p left join part q on q.p_partkey = p.p_partkey + 1),
    ro as (select p_brand as company, p_name as role, list_distinct(string_split(p_name, ' ')) as tokens from part group by 1, 2)"""


@query("signal_roles", f"""with {_EV}, hit as (select evidence_id, role, len(tokens) as n, max(len(tokens)) over (partition by evidence_id) as top from ev join ro using (company) where len(tokens) >= 2 and list_has_all(words, tokens)),
    best as (select evidence_id, case when count(distinct role) = 1 then min(role) end as role from hit where n = top group by 1) select ev.evidence_id, best.role from ev left join best using (evidence_id)""")
def signal_roles(spark, d):
    p = load(spark, d, "part").select("p_partkey", "p_brand", "p_name")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("more"))
    words = F.array_distinct(F.split(F.concat("p_name", F.lit(" "), F.coalesce("more", F.lit(""))), " "))
    evidence = p.join(after, "p_partkey", "left").select(F.col("p_partkey").alias("evidence_id"), F.col("p_brand").alias("company"), words.alias("words"))
    roles = p.select(F.col("p_brand").alias("company"), F.col("p_name").alias("role")).distinct().withColumn("tokens", F.array_distinct(F.split("role", " ")))
    return L.resolve_signals(evidence, roles)


_SIG = "sig as (select event_id, sha256(concat_ws('|', user_id, event_type, props->>'$.k')) as identity, user_id, event_type as kind, ts::date as seen, ts < timestamp '2024-01-10' as stored from events)"


@query("signals_inserted", f"""with {_SIG}, fresh as (select * from sig where not stored and identity not in (select identity from sig where stored) and (user_id, kind, seen) not in (select (user_id, kind, seen) from sig where stored)),
    one as (select * from fresh qualify row_number() over (partition by identity order by event_id) = 1) select event_id, identity from one qualify row_number() over (partition by user_id, kind, seen order by event_id) = 1""")
def signals_inserted(spark, d):
    key = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.get_json_object("props", "$.k")), 256)
    s = load(spark, d, "events").select("event_id", key.alias("identity"), "user_id", F.col("event_type").alias("kind"), F.to_date("ts").alias("seen"), (F.col("ts") < F.lit("2024-01-10").cast("timestamp")).alias("stored"))
    return L.insert_once(s.where("not stored"), s.where("stored"), "identity", ["user_id", "kind", "seen"], "event_id").select("event_id", "identity")


@query("role_titles", """with t as (select l_suppkey as role_id, p_name || ' ' || year(l_shipdate) as title, min(l_shipdate)::date as first_seen, max(l_shipdate)::date as last_seen from lineitem join part on p_partkey = l_partkey group by 1, 2)
    select role_id, list(title order by first_seen, title)[1] as earliest, max_by(title, last_seen::varchar || title) as newest, max(regexp_extract(title, '(19|20)[0-9]{2}')::int) as cohort, md5(string_agg(title, ' ' order by first_seen, title)) as titles_md5 from t group by 1""")
def role_titles(spark, d):
    li = load(spark, d, "lineitem").select("l_suppkey", "l_partkey", F.to_date("l_shipdate").alias("on"))
    # Pre-aggregated by title before any list is made.
    t = li.join(load(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("role_id"), F.concat_ws(" ", "p_name", F.year("on").cast("string")).alias("title")).agg(F.min("on").alias("first_seen"), F.max("on").alias("last_seen"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_seen", "title"))), lambda x: x["title"]), " ")
    return t.groupBy("role_id").agg(
        F.min(F.struct("first_seen", "title"))["title"].alias("earliest"), F.max(F.struct("last_seen", "title"))["title"].alias("newest"),
        F.max(F.regexp_extract("title", "(19|20)[0-9]{2}", 0).try_cast("int")).alias("cohort"), F.md5(listed.cast("binary")).alias("titles_md5"),
    )


@query("role_events_json", """select o_custkey as role_id, to_json(list({'opened_on': strftime(o_orderdate, '%Y-%m-%d'), 'id': o_orderkey} order by o_orderdate, o_orderkey))::varchar as openings from orders group by 1""")
def role_events_json(spark, d):
    o = load(spark, d, "orders").select("o_custkey", F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("opened_on"), F.col("o_orderkey").alias("id")).alias("e"))
    return o.groupBy(F.col("o_custkey").alias("role_id")).agg(F.to_json(F.array_sort(F.collect_list("e"))).alias("openings"))


@query("unresolved_observations", """select o_orderkey as observation_id, o_orderdate::date as first_seen from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'A')""")
def unresolved_observations(spark, d):
    """Postings without a primary match, the oldest first."""
    matched = load(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    left = load(spark, d, "orders").select("o_orderkey", "o_orderdate").join(matched, "o_orderkey", "left_anti")
    return left.orderBy("o_orderdate", "o_orderkey").select(F.col("o_orderkey").alias("observation_id"), F.to_date("o_orderdate").alias("first_seen"))


@query("capture_visibility", """with last as (select user_id, event_type = 'error' as degraded from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)
    select event_id, case when event_type = 'purchase' then 'present' when event_type <> 'error' and not degraded and (props->>'$.k')::int < 50 then 'absent' else 'unknown' end as visibility, event_type = 'error' or degraded as is_partial from events join last using (user_id)""")
def capture_visibility(spark, d):
    """Presence stands; absence counts only in a complete capture of a recruiting page, and no capture of a source
    whose latest fetch is degraded is complete."""
    e = load(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("_l")).select("user_id", (F.col("_l") == "error").alias("degraded"))
    partial = (F.col("event_type") == "error") | F.col("degraded")
    seen = F.when(F.col("event_type") == "purchase", "present").when(~partial & (F.get_json_object("props", "$.k").cast("int") < 50), "absent").otherwise("unknown")
    return e.join(last, "user_id").select("event_id", seen.alias("visibility"), partial.alias("is_partial"))


_COMP = """x as (select c_nationkey as company_id, c_mktsegment as name, count(*) filter (c_acctbal > 0) as before, count(*) as after from customer group by 1, 2)"""


@query("changed_components", f"with {_COMP} select company_id, name from x where before <> after")
def changed_components(spark, d):
    return _components(spark, d).where(~F.col("before").eqNullSafe(F.col("after"))).select("company_id", "name")


def _components(spark, d):
    return load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("company_id"), F.col("c_mktsegment").alias("name")).agg(F.count_if(F.col("c_acctbal") > 0).alias("before"), F.count("*").alias("after"))


@query("pass_skips", f"""with {_COMP}, k as (select company_id, sha256(string_agg(name || '=' || before, chr(10) order by name) ) as stored, sha256(string_agg(name || '=' || after, chr(10) order by name)) as key from x group by 1)
    select company_id, key, stored = key as skipped from k""")
def pass_skips(spark, d):
    """Companies whose inputs equal those of their last pass are skipped."""
    part = lambda c: L.fingerprint(F.collect_list(F.concat_ws("=", "name", F.col(c).cast("string"))))
    return _components(spark, d).groupBy("company_id").agg(part("before").alias("stored"), part("after").alias("key")).select("company_id", "key", (F.col("stored") == F.col("key")).alias("skipped"))


@query("added_lines", """select b.doc_id, array_to_string(list_filter(string_split(b.text, chr(10)), lambda x: not list_contains(list_transform(string_split(a.text, chr(10)), lambda y: lower(y)), lower(x)) and regexp_matches(lower(x), '[0-9]'))[:5], ' · ') as added
    from documents b join documents a on a.doc_id = b.doc_id - 1 where a.text is not null and b.text is not null""")
def added_lines(spark, d):
    t = load(spark, d, "documents").select("doc_id", "text").where("text is not null")
    return t.join(t.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("before")), "doc_id").select("doc_id", L.added_lines(F.col("before"), F.col("text"), "[0-9]").alias("added"))
