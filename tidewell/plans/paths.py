"""Recruiting-path rules over addresses made from the pages' hosts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import paths as P
from tidewell.registry import query
from tidewell.session import load

#: Paths put behind each page's host, so that every rule meets addresses it takes and refuses.
ROUTES = (
    "/careers", "/careers/4981249", "/jobs/legal-intern", "/legal/jobs", "/blog/careers-day", "/2024/05/hiring", "/join-us/jobs/technology", "/sitemap.xml", "/sitemap-careers.xml",
    "/sitemaps/games.xml", "/internet", "/hrt-job/hardware-engineer-2027", "/tags/university-recruiting", "/early-careers/emerging-talent-2026", "/", "/jobs/0a1b2c3d-0000-1111-2222-333344445555?x=1",
    "/openings/stories/x", "/wp-json/jobs", "/about-us/Work-At-Home", "/jobshub#top",
)
ADAPTERS = ("generic", "sitemap", "wayback", "greenhouse")
_LIST = "[" + ", ".join(f"'{r}'" for r in ROUTES) + "]"
_SOURCES = f"""sources as (select page_id, ['generic','sitemap','wayback','greenhouse'][page_id // {len(ROUTES)} % 4 + 1] as adapter,
        case when page_id % 3 = 0 then 'https://careers.' else 'https://www.' end || regexp_extract(url, '{P.HOST}', 1) || {_LIST}[page_id % {len(ROUTES)} + 1] as url from pages),
    parts as (select *, lower(regexp_extract(url, '{P.PATH}', 1)) as p, string_split(lower(regexp_extract(url, '{P.HOST}', 1)), '.') as labels from sources),
    segs as (select *, list_filter(string_split(p, '/'), lambda s: s <> '') as s from parts)"""


def _pad(x: str) -> str:
    return f"(' ' || regexp_replace({x}, '[^a-z0-9]+', ' ', 'g') || ' ')"


def _has(x: str, words: str) -> str:
    return f"regexp_matches({_pad(x)}, ' (?:{words}) ')"


_RULES = f"""rules as (select *, regexp_matches(p, '{P.ARCHIVE}') or len(list_filter(s, lambda x, i: regexp_matches(regexp_extract(x, '[a-z0-9]+'), '^(?:{P.SECTION})$') and not coalesce({_has("s[i - 1]", P.PARENT)}, false))) > 0 as section,
        coalesce(regexp_matches(s[-1], '{P.POSTING_ID}') or ({_has("s[-1]", P.ROLE)} and len(list_filter(s[:-2], lambda x: {_has("x", P.PARENT)})) > 0), false) as single,
        len(list_filter(labels[:-3], lambda x: {_has("x", P.RECRUITING)})) > 0 as host, {_has("p", P.RECRUITING)} as named, len(list_filter(s[:-2], lambda x: {_has("x", P.POSTING)})) > 0 as below,
        regexp_matches(p, '{P.ROOT_SITEMAP}') and regexp_matches({_pad("p")}, '^ *(?:(?:{P.GENERIC}) +)*$') as root from segs),
    refused as (select *, case when adapter = 'sitemap' then case when section or not (named or root) then 'not_a_recruiting_sitemap' end
        when adapter in ('generic', 'wayback') then case when section then 'in_a_non_recruiting_section' when single then 'a_single_job_posting' when not (host or named) then 'off_the_recruiting_path' end end as refusal from rules)"""


def _sources(spark, d):
    pages = load(spark, d, "pages")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (F.pmod(i, F.lit(len(values))) + 1).cast("int"))
    host = F.concat(F.when(F.col("page_id") % 3 == 0, "https://careers.").otherwise("https://www."), F.regexp_extract("url", P.HOST, 1))
    return pages.select("page_id", pick(ADAPTERS, F.floor(F.col("page_id") / len(ROUTES))).alias("adapter"), F.concat(host, pick(ROUTES, F.col("page_id"))).alias("url"))


@query("path_rules", f"""with {_SOURCES}, {_RULES} select page_id, url, section as not_a_posting, single as single_job, host as recruiting_host, not section and (host or named) as recruiting_page,
    not section and below as sitemap_job, not section and (named or root) as recruiting_sitemap from refused""")
def path_rules(spark, d):
    u = F.col("url")
    return _sources(spark, d).select(
        "page_id", "url", P.not_a_posting_page(u).alias("not_a_posting"), P.single_job_page(u).alias("single_job"), P.recruiting_host(u).alias("recruiting_host"),
        P.recruiting_page(u).alias("recruiting_page"), P.sitemap_job_page(u).alias("sitemap_job"), P.recruiting_sitemap(u).alias("recruiting_sitemap"),
    )


@query("source_refusals", f"with {_SOURCES}, {_RULES} select page_id, adapter, url, refusal from refused where refusal is not null")
def source_refusals(spark, d):
    """Sources to retire, each with the rule that refuses it."""
    return _sources(spark, d).select("page_id", "adapter", "url", P.refusal(F.col("adapter"), F.col("url")).alias("refusal")).where("refusal is not null")


@query("refusal_counts", f"with {_SOURCES}, {_RULES} select adapter, coalesce(refusal, 'allowed') as outcome, count(*) as sources from refused group by 1, 2")
def refusal_counts(spark, d):
    return _sources(spark, d).groupBy("adapter", F.coalesce(P.refusal(F.col("adapter"), F.col("url")), F.lit("allowed")).alias("outcome")).agg(F.count("*").alias("sources"))


@query("archive_targets", f"""with {_SOURCES}, {_RULES}, ranked as (select *, row_number() over (partition by labels[-2] || '.' || labels[-1] order by not (not section and (host or named)), regexp_matches(p, '(?:19|20)[0-9]{{2}}'), len(s), url, page_id) as r from refused)
    select labels[-2] || '.' || labels[-1] as site, page_id, url from ranked where r = 1""")
def archive_targets(spark, d):
    """The page of a site to look up in archives: a recruiting page, naming no year, the shallowest."""
    u = F.col("url")
    labels = F.split(F.lower(F.regexp_extract(u, P.HOST, 1)), r"\.")
    site = F.concat_ws(".", F.try_element_at(labels, F.lit(-2)), F.try_element_at(labels, F.lit(-1)))
    rank = F.struct((~P.recruiting_page(u)).alias("a"), P.path(u).rlike("(?:19|20)[0-9]{2}").alias("b"), F.size(P.segments(u)).alias("c"), u.alias("url"), F.col("page_id").alias("page_id"))
    return _sources(spark, d).groupBy(site.alias("site")).agg(F.min(rank).alias("best")).select("site", "best.page_id", "best.url")
