"""Replay totals, tallies, splits, record identities and source state, on the supplied tables.

posting = part, role = customer or supplier, opening and forecast = order, match and citation = line item, fetch = event."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell import standins as S
from tidewell.functions import text as T
from tidewell.operators import records as R
from tidewell.plans.texts import _TITLES, titles
from tidewell.registry import query
from tidewell.session import load

SEARCH = " 7 nation_1"
AS_OF = "1998-03-05"


@query("literal_search", f"""select c_custkey as role_id from customer join nation on n_nationkey = c_nationkey where strpos(lower(c_name || ' ' || n_name), lower(trim('{SEARCH}'))) > 0 or strpos(lower(c_name || ' ' || n_name), '%') > 0""")
def literal_search(spark, d):
    r = S.roles(spark, d).join(S.companies(spark, d), "company_id")
    shown = F.concat_ws(" ", "title", "company")
    return r.where(R.literal_match(shown, F.lit(SEARCH)) | R.literal_match(shown, F.lit("%"))).select("role_id")


_REPLAY = """h as (select role_id, count(*) filter (where precision in ('exact', 'bounded')) as scoreable from openings group by role_id having count(*) >= 2),
    t as (select role_id, precision from (select *, row_number() over (partition by role_id order by opened_on desc, event_id) as n from openings where precision in ('exact', 'bounded')) join h using (role_id) where n = 1)"""


@query("replay_summary", S.with_sql("openings", f""", {_REPLAY} select (select count(*) from h) as roles_with_history, (select count(*) from h where scoreable = 0) as observed_by_only, (select count(*) from t) as candidates,
    (select count(*) from t where precision = 'exact') as exact_candidates, (select count(*) from t where precision = 'bounded') as bounded_candidates"""))
def replay_summary(spark, d):
    return R.replay_summary(S.openings(spark, d), "role_id", "precision")


@query("replay_companies", S.with_sql("openings roles companies", f""", {_REPLAY} select company, count(*) as candidates from t join roles using (role_id) join companies using (company_id) group by company"""))
def replay_companies(spark, d):
    o = S.openings(spark, d).groupBy("role_id").agg(F.count("*").alias("n"), F.count_if(F.col("precision") != "observed_by").alias("m")).where("n >= 2 and m > 0")
    # A role has one target, so candidates are counted by company number before names are joined.
    counted = o.join(S.roles(spark, d).select("role_id", "company_id"), "role_id").groupBy("company_id").agg(F.count("*").alias("candidates"))
    return counted.join(S.companies(spark, d), "company_id").select("company", "candidates")


@query("feed_tallies", S.with_sql("openings roles companies", """, f as (select company, family, level, precision from openings join roles using (role_id) join companies using (company_id) where opened_on between (select max(opened_on) from openings) - 45 and (select max(opened_on) from openings))
    select 'company' as facet, company as value, count(*) as items from f group by all union all select 'family', family, count(*) from f group by all union all select 'level', level, count(*) from f group by all union all select 'precision', precision, count(*) from f group by all"""))
def feed_tallies(spark, d):
    o = S.openings(spark, d)
    recent = o.where(F.col("opened_on") >= F.date_sub(o.agg(F.max("opened_on")).scalar(), 45)).join(S.roles(spark, d), "role_id").join(S.companies(spark, d), "company_id")
    return R.tallies(recent, ["company", "family", "level", "precision"])


@query("contribution_totals", """select l_orderkey as forecast_id, l_returnflag as contribution, count(*) as receipts, round(sum(l_quantity / 100), 6) as weight, min(l_linestatus) = max(l_linestatus) as uniform from lineitem group by all""")
def contribution_totals(spark, d):
    rows = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("forecast_id"), F.col("l_returnflag").alias("contribution"), "l_quantity", "l_linestatus")
    return R.contribution_totals(rows, ["forecast_id", "contribution"], F.col("l_quantity") / 100, "l_linestatus")


_STATED = r"""array_to_string(list_filter([case when regexp_matches(lower(title), '\bapprentice(ship)?s?\b') then 'apprenticeship' end, case when regexp_matches(lower(title), '\b(intern|interns|internship|internships|co-?op)\b') then 'internship' end,
    case when regexp_matches(lower(title), '\b(new[-\s]grad(uate)?|university grad(uate)?|early career)\b') then 'new_grad' end], lambda x: x is not null), ' ')"""


@query("identity_splits", f"""with {_TITLES}, o as (select posting_id, posting_id // 10 as role_id, title, {_STATED} as stated from titles), n as (select role_id, stated, title, count(*) as c from o group by all),
    g as (select role_id, stated, sum(c)::bigint as observations, first(title order by c desc, length(title) desc, title desc) as title from n group by all), k as (select *, row_number() over (partition by role_id order by observations desc, stated = '', stated) as r, count(*) over (partition by role_id) as groups from g)
    select role_id, stated, observations, title, r = 1 as keeps from k where groups > 1""")
def identity_splits(spark, d):
    return R.identity_splits(titles(spark, d).withColumn("role_id", F.floor(F.col("posting_id") / 10).cast("bigint")), "role_id", "posting_id", "title")


@query("title_years", rf"""with {_TITLES} select posting_id // 10 as role_id, max(nullif(regexp_extract(title, '\b(20[0-9]{{2}})\b', 1), '')::int) as last_year, string_agg(title, ' ' order by title) as titles from titles group by 1""")
def title_years(spark, d):
    year = F.regexp_extract("title", r"\b(20[0-9]{2})\b", 1).try_cast("int")
    return titles(spark, d).groupBy(F.floor(F.col("posting_id") / 10).cast("bigint").alias("role_id")).agg(F.max(year).alias("last_year"), F.array_join(F.array_sort(F.collect_list("title")), " ").alias("titles"))


_IDENTITY = r"""sha256(concat_ws('|', user_id::varchar, event_type, 'https://x.example/' || (event_id % 50)::varchar, case when event_id % 3 = 0 then ts::date::varchar else '' end, case when event_id % 4 = 0 then 'opened' else '' end, trim(regexp_replace(lower('  Spring  ROLE ' || props), '\s+', ' ', 'g'))))"""


@query("signal_identity", f"select event_id, {_IDENTITY} as identity from events")
def signal_identity(spark, d):
    k = F.col("event_id")
    url = F.concat(F.lit("https://x.example/"), (k % 50).cast("string"))
    claimed = F.when(k % 3 == 0, F.to_date("ts"))
    return load(spark, d, "events").select("event_id", R.signal_identity(F.col("user_id"), F.col("event_type"), url, claimed, F.when(k % 4 == 0, "opened"), F.concat(F.lit("  Spring  ROLE "), "props")).alias("identity"))


@query("signal_ids", f"""with h as (select p_partkey, sha1(unhex('{R.SIGNAL_NAMESPACE.replace("-", "")}') || encode(p_name || p_partkey::varchar)) as h from part)
    select p_partkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || case when h[17] in ('0', '4', '8', 'c') then '8' when h[17] in ('1', '5', '9', 'd') then '9' when h[17] in ('2', '6', 'a', 'e') then 'a' else 'b' end || h[18:20] || '-' || h[21:32] as signal_id from h""")
def signal_ids(spark, d):
    return load(spark, d, "part").select("p_partkey", T.uuid5(R.SIGNAL_NAMESPACE, F.concat(F.col("p_name"), F.col("p_partkey").cast("string"))).alias("signal_id"))


@query("meaningful_hashes", r"select doc_id, sha256(array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '\r\n|\n|\r'), lambda x: x <> ''))), chr(10))) as digest from documents")
def meaningful_hashes(spark, d):
    return load(spark, d, "documents").select("doc_id", R.meaningful_hash(F.col("text")).alias("digest"))


_MARKS = "[" + ",".join(f"'{p}'" for p in R.CHALLENGES) + "]"


@query("challenges", rf"""with p as (select page_id, left(trim(regexp_replace(lower(case when page_id % 3 = 0 then '<p>' || upper({_MARKS}[page_id % 6 + 1]) || '</p> ' else '' end || html), '\s+', ' ', 'g')), {R.CHALLENGE_CHARS}) as head from pages)
    select page_id, list_filter({_MARKS}, lambda m: contains(head, m))[1] as marker from p""")
def challenges(spark, d):
    said = F.element_at(F.array(*map(F.lit, R.CHALLENGES)), (F.col("page_id") % 6 + 1).cast("int"))
    html = F.concat(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<p>"), F.upper(said), F.lit("</p> "))).otherwise(""), "html")
    return load(spark, d, "pages").select("page_id", R.challenge(html).alias("marker"))


@query("published_dates", """with s as (select o_orderkey, o_orderdate::timestamp as t, o_orderkey % 4 as k from orders) select o_orderkey, case k when 0 then t when 1 then t - interval 2 hour end as published_at, case k when 2 then 'after_observation' when 3 then 'no_time_zone' end as rejected from s""")
def published_dates(spark, d):
    k, t = F.pmod("o_orderkey", F.lit(4)), F.col("o_orderdate").cast("timestamp")
    said = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    stated = F.when(k == 0, F.concat(said(t), F.lit("Z"))).when(k == 1, F.concat(said(t), F.lit("+02:00"))).when(k == 2, F.concat(said(t + F.expr("interval 9 days")), F.lit("Z"))).otherwise(said(t))
    return load(spark, d, "orders").select("o_orderkey", R.published(stated, t + F.expr("interval 1 day")).alias("p")).select("o_orderkey", F.col("p.published_at").cast("timestamp_ntz").alias("published_at"), "p.rejected")


def _fetches(spark, d):
    return load(spark, d, "events").select(F.col("user_id").alias("source_id"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("fetch_id"), (F.col("event_type") == "error").alias("degraded"), (F.col("event_type") != "error").alias("complete"), F.md5("props").alias("content_hash"))


@query("demoted_captures", """with last as (select user_id as source_id, arg_max(event_type = 'error', (ts, event_id)) as bad from events group by 1)
    select l_orderkey, l_linenumber, l_returnflag = 'A' or coalesce(bad, false) as partial, coalesce(bad, false) and l_returnflag <> 'A' as demoted from lineitem left join last on source_id = l_suppkey""")
def demoted_captures(spark, d):
    c = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("source_id"), (F.col("l_returnflag") == "A").alias("partial"))
    return R.demoted(c, _fetches(spark, d), "source_id", "partial").select("l_orderkey", "l_linenumber", "partial", "demoted")


@query("fetch_state", """select user_id as source_id, count(*) as fetches, arg_max(event_type <> 'error', (ts, event_id)) as complete, arg_max(md5(props), (ts, event_id)) filter (where event_type <> 'error') as last_content_hash from events group by 1""")
def fetch_state(spark, d):
    return R.fetch_state(_fetches(spark, d), "source_id")


@query("cursor_state", """with p as (select user_id as source_id, ts::date as passed_on, count(*) filter (where event_type = 'error') as failures from events group by all), c as (select source_id, max(passed_on) filter (where failures = 0) as cursor_on from p group by 1)
    select source_id, any_value(cursor_on) as cursor_on, count(*) filter (where cursor_on is null or passed_on > cursor_on) as behind from c join p using (source_id) group by source_id""")
def cursor_state(spark, d):
    passes = _fetches(spark, d).groupBy("source_id", F.to_date("fetched_at").alias("passed_on")).agg(F.count_if("degraded").alias("failures"))
    return R.cursors(passes, "source_id")


@query("trimmable_postings", """select p_partkey as posting_id from part where exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'R' and l_linenumber < 3) and not exists (select 1 from lineitem join supplier on s_suppkey = l_suppkey where l_partkey = p_partkey and l_returnflag = 'R' and l_linenumber < 3 and s_acctbal > 2000)""")
def trimmable_postings(spark, d):
    postings = load(spark, d, "part").select(F.col("p_partkey").alias("posting_id"))
    matches = load(spark, d, "lineitem").where("l_returnflag = 'R' and l_linenumber < 3").select(F.col("l_partkey").alias("posting_id"), F.col("l_suppkey").alias("role_id"))
    roles = load(spark, d, "supplier").select(F.col("s_suppkey").alias("role_id"), F.when(F.col("s_acctbal") > 5000, "in_scope").when(F.col("s_acctbal") > 2000, "ambiguous").otherwise("out_of_scope").alias("scope"))
    return R.trimmable(postings, matches, roles, "posting_id", "role_id")


@query("current_postings", """with f as (select o_custkey, max(o_orderdate) - interval 200 day as fetched from orders where o_orderstatus = 'F' group by 1) select o_orderkey as posting_id, o_custkey as source_id from orders join f using (o_custkey) where o_orderdate >= fetched""")
def current_postings(spark, d):
    """Postings seen in or after their source's last fetch."""
    o = load(spark, d, "orders")
    fetched = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("m"))
    return o.join(fetched, "o_custkey").where(F.col("o_orderdate") >= F.col("m") - F.expr("interval 200 days")).select(F.col("o_orderkey").alias("posting_id"), F.col("o_custkey").alias("source_id"))


@query("citing_roles", """with latest as (select o_custkey as role_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as forecast_id from orders group by 1)
    select distinct s_nationkey as company_id, role_id from latest join lineitem on l_orderkey = forecast_id join supplier on s_suppkey = l_suppkey join customer on c_custkey = role_id where c_nationkey <> s_nationkey""")
def citing_roles(spark, d):
    """Other companies' roles whose latest forecast cites a company's evidence."""
    latest = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("role_id")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("l_orderkey"))
    cited = load(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(latest, "l_orderkey")
    owner = load(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("company_id"))
    own = load(spark, d, "customer").select(F.col("c_custkey").alias("role_id"), "c_nationkey")
    return cited.join(owner, "l_suppkey").select("company_id", "role_id").distinct().join(own, "role_id").where("c_nationkey <> company_id").select("company_id", "role_id")


@query("company_observations", """select company_id, count(*) as observations from (select c_nationkey as company_id, o_orderkey from orders join customer on c_custkey = o_custkey union select s_nationkey, l_orderkey from lineitem join supplier on s_suppkey = l_suppkey) group by 1""")
def company_observations(spark, d):
    """Observations of a company's sources and of its roles, each once."""
    a = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("company_id"), "o_orderkey")
    b = load(spark, d, "lineitem").join(load(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_nationkey", "l_orderkey")
    return a.union(b).distinct().groupBy("company_id").agg(F.count("*").alias("observations"))


@query("new_families", f"""with f as (select c_nationkey as company_id, lower(trim(c_mktsegment || ' ' || (o_orderkey % 97)::varchar || ' ')) as family, o_orderdate >= timestamp '{AS_OF}' as after from orders join customer on c_custkey = o_custkey),
    g as (select company_id, family, bool_or(after) and not bool_or(not after) as fresh from f group by all) select company_id, array_to_string(list_sort(coalesce(list(family) filter (where fresh), [])), ', ') as families from g group by 1""")
def new_families(spark, d):
    """Families of a company's board that its earlier state lacks."""
    j = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    after = F.col("o_orderdate") >= F.lit(AS_OF).cast("timestamp")
    family = F.lower(F.trim(F.concat_ws(" ", "c_mktsegment", (F.col("o_orderkey") % 97).cast("string"), F.lit(""))))
    sets = j.groupBy(F.col("c_nationkey").alias("company_id")).agg(F.collect_set(F.when(after, family)).alias("now"), F.collect_set(F.when(~after, family)).alias("was"))
    return sets.select("company_id", F.array_join(F.array_sort(F.array_except("now", "was")), ", ").alias("families"))


@query("month_openings", f"""select o_orderkey as forecast_id from orders where o_orderdate::date <= last_day(date '{AS_OF}') and o_orderdate::date + 20 >= date '{AS_OF}'""")
def month_openings(spark, d):
    """Forecasts whose window of 20 days meets the rest of the month."""
    start, end = R.month_window(F.to_date(F.lit(AS_OF)))
    on = F.to_date("o_orderdate")
    return load(spark, d, "orders").where((on <= end) & (F.date_add(on, 20) >= start)).select(F.col("o_orderkey").alias("forecast_id"))


@query("input_fingerprints", S.with_sql("roles", """select role_id, sha256('{"company_id":' || company_id::varchar || ',"family":"' || family || '","level":"' || level || '","role_id":' || role_id::varchar || ',"season":"' || season || '"}') as fingerprint from roles"""))
def input_fingerprints(spark, d):
    """sha256 of canonical JSON: names in order, no spaces."""
    return S.roles(spark, d).select("role_id", F.sha2(F.to_json(F.struct("company_id", "family", "level", "role_id", "season")), 256).alias("fingerprint"))


@query("skip_rate", "select ts::date as day, count(*) as considered, count(*) filter (where starts_with(event_type, 's')) as skipped from events group by 1")
def skip_rate(spark, d):
    return load(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("considered"), F.count_if(F.startswith("event_type", F.lit("s"))).alias("skipped"))


@query("token_containment", rf"""with {_TITLES}, w as (select posting_id, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) as t from titles) select a.posting_id, round(len(list_intersect(a.t, b.t)) / len(a.t)::double, 6) as share, len(list_intersect(a.t, b.t)) = len(a.t) as contained from w a join w b on b.posting_id = a.posting_id + 7""")
def token_containment(spark, d):
    """The share of a title's words that the title of the same kind after it has too; null for a title without words."""
    w = titles(spark, d).select("posting_id", F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("[a-z0-9]+"), F.lit(0))).alias("t"))
    j = w.join(w.select((F.col("posting_id") - 7).alias("posting_id"), F.col("t").alias("u")), "posting_id")
    return j.select("posting_id", F.round(F.try_divide(F.size(F.array_intersect("t", "u")), F.size("t")), 6).alias("share"), (F.size(F.array_except("t", "u")) == 0).alias("contained"))


def _runs(spark, d):
    """Backtest runs: one for each nation, its customers' orders being targets; those not filled were skipped, and some of both."""
    o = load(spark, d, "orders").join(load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("run_id")), "o_custkey")
    k, year = F.col("o_orderkey"), F.year("o_orderdate")
    cases = o.where("o_orderstatus = 'F'").select("run_id", k.alias("event_id"), F.col("o_custkey").alias("role_id"), year.alias("year"))
    item = F.struct(k.alias("target_event_id"), F.col("o_custkey").alias("role_id"), year.alias("target_year"), F.concat(F.lit("reason "), "o_orderstatus", (k % 3).cast("string")).alias("reason"))
    left = o.where((F.col("o_orderstatus") != "F") | (k % 5 == 0))
    # A run's skipped targets lie in documents of bounded size.
    notes = left.groupBy("run_id", F.pmod(F.xxhash64("o_orderkey"), F.lit(64)).alias("part")).agg(F.to_json(F.struct(F.collect_list(item).alias("skipped_targets"))).alias("metrics"))
    ends = o.groupBy("run_id").agg(F.max("o_orderdate").alias("finished_at"), F.min("o_orderdate").alias("created_at"))
    return notes.join(ends, "run_id").select("run_id", "finished_at", "created_at", "metrics"), cases


_OUTCOMES = """t as (select o_orderkey as event_id, o_custkey as role_id, year(o_orderdate) as year, o_orderdate, o_orderstatus, c_nationkey as run_id from orders join customer on c_custkey = o_custkey),
    latest as (select run_id from t group by 1 having count(*) filter (o_orderstatus <> 'F' or event_id % 5 = 0) > 0 order by max(o_orderdate) desc, min(o_orderdate) desc, run_id limit 1),
    outcomes as (select event_id, role_id, year, case o_orderstatus when 'F' then 'scored' else 'skipped' end as outcome, case when o_orderstatus <> 'F' then 'reason ' || o_orderstatus || (event_id % 3) end as reason from t join latest using (run_id))"""


@query("latest_outcomes", f"with {_OUTCOMES} select * from outcomes")
def latest_outcomes(spark, d):
    return R.latest_outcomes(*_runs(spark, d))


@query("replay_page", f"with {_OUTCOMES} select event_id, role_id, outcome, o_orderdate::date as opened_on from outcomes join orders on o_orderkey = event_id order by o_orderdate::date desc, role_id, event_id limit 20 offset 20")
def replay_page(spark, d):
    on = load(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.to_date("o_orderdate").alias("opened_on"))
    rows = R.latest_outcomes(*_runs(spark, d)).join(on, "event_id").select("event_id", "role_id", "outcome", "opened_on")
    return R.page_of(rows, 20, 20, F.desc("opened_on"), F.col("role_id"), F.col("event_id"))
