"""String, address, JSON and vector functions on the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import dates as D
from tidewell.functions import text as T
from tidewell.registry import query
from tidewell.session import load

#: Titles made from part keys: a stand-in for posting titles with years, cohorts and levels.
_KINDS = ("Software Engineer Internship", "SWE New-Grad Program", "Apply for Data Scientist Intern", "Senior Product Manager", "Machine Learning Apprenticeship", "UI Designer (Class of 2027)", "Quant Trading Interns", "Graduate Hardware Engineering Program", "University Backend Developers, New-Graduate", "Cyber Security Analysts, entry level", "Campus Data Engineers Co-op 1999", "Director, Year-Round Consulting")
_TIMES = ("Summer 2025", "Fall 2026", "", "Winter", "2024", "Spring 2031")


def titles(spark, d):
    p = load(spark, d, "part")
    k = F.col("p_partkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.pmod(k, F.lit(n)) + 1).cast("int"))
    return p.select(k.alias("posting_id"), F.concat_ws(" - ", pick(_KINDS, len(_KINDS)), "p_name", F.nullif(pick(_TIMES, 6), F.lit(""))).alias("title"), F.concat(F.col("p_brand"), F.lit(" Holdings, Inc.")).alias("company"), pick(("summer", "unknown"), 2).alias("role_season"))


def _list(values):
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_TITLES = f"""titles as (select p_partkey as posting_id, concat_ws(' - ', {_list(_KINDS)}[(p_partkey % {len(_KINDS)})::int + 1], p_name, nullif({_list(_TIMES)}[(p_partkey % 6)::int + 1], '')) as title, p_brand || ' Holdings, Inc.' as company, ['summer','unknown'][(p_partkey % 2)::int + 1] as role_season from part)"""
_NORM = "lower(title)"
for _pattern, _by in T.TITLE_STEPS:
    _NORM = f"regexp_replace({_NORM}, '{_pattern}', '{_by}', 'g')"
_NORM = f"trim({_NORM})"
_SEASON = "case regexp_extract(lower(title), '\\b(spring|summer|fall|autumn|winter)\\b', 1) when '' then 'unknown' when 'autumn' then 'fall' else regexp_extract(lower(title), '\\b(spring|summer|fall|autumn|winter)\\b', 1) end"


@query("title_normalize", f"with {_TITLES} select posting_id, {_NORM} as title from titles")
def title_normalize(spark, d):
    return titles(spark, d).select("posting_id", T.normalize_title(F.col("title")).alias("title"))


def _rules(text: str, rules, otherwise: str) -> str:
    return "case " + " ".join(f"when regexp_matches({text}, '{rx}') then '{name}'" for name, rx in rules) + f" else {otherwise} end"


def _markers(text: str, rules, otherwise: str) -> str:
    return "case " + " ".join("when " + " or ".join(f"contains({text}, '{m}')" for m in markers) + f" then '{name}'" for name, markers in rules) + f" else {otherwise} end"


_SEASONS = tuple((x, rf"\b{x}\b") for x in ("spring", "summer", "fall", "winter")) + (("year_round", r"\b(year[- ]round|rolling)\b"),)
_BARE = "case when regexp_matches(lower(title), '\\bgraduates?\\b') then 'new_grad' else 'unknown' end"


@query("title_features", f"""with {_TITLES} select posting_id, {_rules("lower(title)", T.LEVELS, _BARE)} as level, {_markers(_NORM, T.FAMILIES, "'other'")} as family, {_markers(f"(' ' || {_NORM} || ' ')", T.SPECIALIZATIONS, "null")} as specialization,
    {_rules("lower(title)", _SEASONS, "'unknown'")} as season, array_to_string(list_filter([{", ".join(f"case when regexp_matches(lower(title), '{rx}') then '{name}' end" for name, rx in T.TRACKS)}], lambda x: x is not null), ' ') as tracks from titles""")
def title_features(spark, d):
    t = F.col("title")
    return titles(spark, d).select("posting_id", T.title_level(t).alias("level"), T.family(t).alias("family"), T.specialization(t).alias("specialization"), T.recruiting_season(t).alias("season"), F.array_join(T.tracks(t), " ").alias("tracks"))


@query("cycle_key_parse", rf"""with {_TITLES}, p as (select *, regexp_extract(title, '\b(20[2-9][0-9])\b', 1) as y, {_SEASON} as s from titles)
    select posting_id, case when y <> '' then (case when s <> 'unknown' then s when role_season = 'unknown' then 'unspecified' else role_season end) || '-' || y end as cycle_key from p""")
def cycle_key_parse(spark, d):
    return titles(spark, d).select("posting_id", T.cycle_key(F.col("title"), F.col("role_season")).alias("cycle_key"))


_FORMS = _list(T.LEGAL_FORMS)
_STOPS = _list(T.TITLE_STOPS)
_SAME = "case w " + " ".join(f"when '{a}' then '{b}'" for a, b in T.INFLECTIONS.items()) + " else w end"


@query("company_normalize", f"with {_TITLES} select posting_id, array_to_string(list_filter(regexp_extract_all(lower(company), '[a-z0-9]+'), lambda w: not list_contains({_FORMS}, w)), ' ') as company, array_to_string(regexp_extract_all(lower(company), '[a-z0-9]+'), '_') as slug from titles")
def company_normalize(spark, d):
    return titles(spark, d).select("posting_id", T.normalize_company(F.col("company")).alias("company"), T.slug(F.col("company")).alias("slug"))


@query("identifying_tokens", f"""with {_TITLES}, n as (select posting_id, {_NORM} as t, list_filter(regexp_extract_all(lower(company), '[a-z0-9]+'), lambda w: not list_contains({_FORMS}, w)) as c from titles)
    select posting_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(t, '[a-z0-9+]+'), lambda w: {_SAME}), lambda w: not list_contains({_STOPS}, w) and not list_contains(c, w)))), ' ') as tokens from n""")
def identifying_tokens(spark, d):
    return titles(spark, d).select("posting_id", F.array_join(T.identifying_tokens(F.col("title"), F.col("company")), " ").alias("tokens"))


@query("token_jaccard", f"""with {_TITLES}, w as (select posting_id, list_distinct(regexp_extract_all({_NORM}, '[a-z0-9+]+')) as t from titles)
    select a.posting_id, round(case when len(a.t) = 0 or len(b.t) = 0 then 0.5 else len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::double end, 6) as similarity from w a join w b on b.posting_id = a.posting_id + 1""")
def token_jaccard(spark, d):
    w = titles(spark, d).select("posting_id", F.array_distinct(F.regexp_extract_all(T.normalize_title(F.col("title")), F.lit("[a-z0-9+]+"), F.lit(0))).alias("t"))
    b = w.select((F.col("posting_id") - 1).alias("posting_id"), F.col("t").alias("u"))
    return w.join(b, "posting_id").select("posting_id", F.round(T.jaccard(F.col("t"), F.col("u")), 6).alias("similarity"))


@query("url_identity", r"""with u as (select page_id, regexp_replace(url, '#.*$', '') as bare from pages), p as (select page_id, lower(regexp_extract(bare, '^([a-zA-Z]+://[^/?]*)', 1)) as host, regexp_replace(regexp_replace(regexp_extract(bare, '^([^?]*)', 1), '^[a-zA-Z]+://[^/]*', ''), '/+$', '') as path,
    list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda q: q <> '' and not regexp_matches(q, '^(utm_[a-z]+|gclid|fbclid|ref|source|gh_src)='))) as q from u)
    select page_id, host || path || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end as url from p""")
def url_identity(spark, d):
    return load(spark, d, "pages").select("page_id", T.identity_url(F.col("url")).alias("url"))


@query("registrable_label", rf"""with h as (select page_id, string_split(lower(regexp_extract(case when page_id % 4 = 0 then regexp_replace(url, '^([a-z]+://[^/:?#]+)', '\1.co.uk') else url end, '^[a-zA-Z]+://([^/:?#]+)', 1)), '.') as l from pages)
    select page_id, case when len(l) >= 3 and l[-2] in {T.SECOND_LEVEL!r} then l[-3] else l[-2] end as label from h""")
def registrable_label(spark, d):
    url = F.when(F.col("page_id") % 4 == 0, F.regexp_replace("url", "^([a-z]+://[^/:?#]+)", "$1.co.uk")).otherwise(F.col("url"))
    return load(spark, d, "pages").select("page_id", T.registrable_label(url).alias("label"))


@query("strip_html", r"""select page_id, left(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'gs'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')), 4000) as text from pages""")
def strip_html(spark, d):
    return load(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query("anchors", r"""select page_id, href, count(*) as links from (select page_id, unnest(regexp_extract_all(html, '<a[^>]+href="([^"]*)"', 1)) as href from pages) group by all""")
def anchors(spark, d):
    p = load(spark, d, "pages")
    return p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a[^>]+href="([^"]*)"'), F.lit(1))).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("links"))


@query("redacted", r"""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)bearer\s+[A-Za-z0-9._-]+', 'Bearer [redacted]', 'g'), '(?i)\b(token|secret|password|api_key)(\s*=\s*)"?[A-Za-z0-9_-]+"?', '\1\2[redacted]', 'g'), '://[^/@\s:]+:[^/@\s]+@', '://[redacted]@', 'g'),
    '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), '\+?[0-9][0-9 ()-]{7,}[0-9]', '[phone]', 'g')) as digest from documents""")
def redacted(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(T.redact(F.col("text"))).alias("digest"))


@query("json_unnest", "select event_id, key, (props->>('$.' || key))::int as value from (select event_id, props, unnest(json_keys(props)) as key from events)")
def json_unnest(spark, d):
    e = load(spark, d, "events")
    return e.select("event_id", F.explode(F.from_json("props", "map<string,int>")).alias("key", "value"))


@query("skip_reasons_json", "select (props->>'$.k')::int // 25 as reason, count(*) as items from events group by 1")
def skip_reasons_json(spark, d):
    return load(spark, d, "events").select(F.floor(F.get_json_object("props", "$.k").cast("int") / 25).cast("int").alias("reason")).groupBy("reason").agg(F.count("*").alias("items"))


@query("identity_hash", "select p_partkey, sha256(concat_ws('|', coalesce(p_brand, ''), coalesce(p_name, ''), coalesce(p_type, ''))) as identity from part")
def identity_hash(spark, d):
    field = lambda c: F.coalesce(F.col(c), F.lit(""))
    return load(spark, d, "part").select("p_partkey", F.sha2(F.concat_ws("|", field("p_brand"), field("p_name"), field("p_type")), 256).alias("identity"))


@query("display_titles", "select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') as title from part")
def display_titles(spark, d):
    return load(spark, d, "part").select("p_partkey", T.display_title(F.col("p_name")).alias("title"))


@query("confidence_phrases", "select c_custkey, case when c_acctbal < 0 then 'no forecast' else case when c_acctbal / 100 >= 75 then 'strong' when c_acctbal / 100 >= 60 then 'moderate' else 'limited' end || ' confidence (' || round(c_acctbal / 100)::int || '%)' end as phrase from customer")
def confidence_phrases(spark, d):
    c = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 100)
    return load(spark, d, "customer").select("c_custkey", T.confidence_phrase(c).alias("phrase"))


@query("evidence_quote", "select doc_id, case when instr(text, 'the') > 0 then substring(text, greatest(1, instr(text, 'the') - 160)::int, 1000) end as quote from documents")
def evidence_quote(spark, d):
    return load(spark, d, "documents").select("doc_id", T.quote(F.col("text"), F.lit("the")).alias("quote"))


@query("days_until", "select o_orderkey, greatest(0, round((epoch_us(o_orderdate + interval 12 hour) - epoch_us(timestamp '1998-03-05 07:30:00')) / 86400000000.0))::int as days from orders")
def days_until(spark, d):
    return load(spark, d, "orders").select("o_orderkey", D.days_until(F.to_date("o_orderdate"), F.lit("1998-03-05 07:30:00").cast("timestamp")).alias("days"))


@query("parsed_dates", """select o_orderkey, o_orderdate as parsed from orders""")
def parsed_dates(spark, d):
    o = load(spark, d, "orders")
    k = F.pmod("o_orderkey", F.lit(5))
    t = F.col("o_orderdate")
    spelled = (
        F.when(k == 0, F.date_format(t, "yyyy-MM-dd")).when(k == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 2, F.concat(F.date_format(t, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .when(k == 3, F.unix_timestamp(t).cast("string")).otherwise(F.concat(F.unix_timestamp(t).cast("string"), F.lit("000")))
    )
    return o.select("o_orderkey", D.parse_timestamp(spelled).alias("parsed"))


@query("cosine_topk", """with q as (select vec_id as query_id, embedding as q from embeddings where vec_id % 50 = 0)
    select query_id, vec_id, r::int as rank from (select query_id, vec_id, row_number() over (partition by query_id order by round(list_cosine_similarity(q::double[], embedding::double[]), 9) desc, vec_id) as r from q, embeddings where vec_id <> query_id) where r <= 5""")
def cosine_topk(spark, d):
    """Every row whose id is divisible by 50 against all rows, in blocks of at most about 200 queries:
    a block is one row, and every row is scored where it lies. A vector of zeros is like no other: 0."""
    e = load(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    e = e.withColumn("u", norm("v"))
    asked = e.where("vec_id % 50 = 0")
    n_blocks = asked.count() // 200 + 1
    blocks = asked.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("k")).agg(F.collect_list(F.struct(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("u").alias("n"))).alias("block"))
    scored = e.join(blocks.select("block")).select("vec_id", "v", "u", F.explode("block").alias("b")).where("vec_id <> b.query_id")
    dot = F.aggregate(F.zip_with("v", "b.q", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    s = scored.select(F.col("b.query_id").alias("query_id"), "vec_id", F.round(F.coalesce(F.try_divide(dot, F.col("u") * F.col("b.n")), F.lit(0.0)), 9).alias("s"))
    w = Window.partitionBy("query_id").orderBy(F.col("s").desc(), "vec_id")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("query_id", "vec_id", "rank")
