"""Posting sources: structured payloads, feeds, sitemaps, archive indexes, page markup.

Each function takes a table with one document in ``body`` (text, as a file or a page
table gives it) and returns one row for each posting, with the fields by which
postings are known. Malformed documents give no rows; ``ladder.diagnostics`` tells those of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import dates as D

POSTING = ("external_id", "title", "url", "location", "department", "published_at", "content")


def _rows(df: DataFrame, items: Column, **fields) -> DataFrame:
    keep = [c for c in df.columns if c != "body"]
    exploded = df.select(*keep, F.explode(items).alias("j"))
    none = F.lit(None).cast("string")
    return exploded.select(*keep, *[fields.get(c, none).alias(c) for c in POSTING]).where("title is not null and url is not null")


def greenhouse(df: DataFrame) -> DataFrame:
    schema = "jobs array<struct<id:bigint,title:string,absolute_url:string,location:struct<name:string>,first_published:string,updated_at:string,content:string,departments:array<struct<name:string>>>>"
    j = F.col("j")
    names = F.array_join(F.transform(j["departments"], lambda x: x["name"]), "; ")
    # first_published is a publication date; updated_at never is.
    return _rows(df, F.from_json("body", schema)["jobs"], external_id=j["id"].cast("string"), title=j["title"], url=j["absolute_url"], location=j["location"]["name"], department=names, published_at=D.parse_timestamp(j["first_published"]).cast("string"), content=j["content"])


def lever(df: DataFrame) -> DataFrame:
    schema = "array<struct<id:string,text:string,hostedUrl:string,applyUrl:string,createdAt:bigint,categories:struct<location:string,commitment:string,team:string,department:string>,descriptionPlain:string>>"
    j = F.col("j")
    dept = F.nullif(F.concat_ws("; ", j["categories"]["department"], j["categories"]["team"]), F.lit(""))
    return _rows(df, F.from_json("body", schema), external_id=j["id"], title=j["text"], url=F.coalesce(j["hostedUrl"], j["applyUrl"]), location=j["categories"]["location"], department=dept, published_at=F.timestamp_millis(j["createdAt"]).cast("string"), content=j["descriptionPlain"])


def ashby(df: DataFrame) -> DataFrame:
    schema = "jobs array<struct<id:string,title:string,jobUrl:string,applyUrl:string,location:string,employmentType:string,department:string,team:string,publishedAt:string,descriptionHtml:string>>"
    j = F.col("j")
    return _rows(df, F.from_json("body", schema)["jobs"], external_id=j["id"], title=j["title"], url=F.coalesce(j["jobUrl"], j["applyUrl"]), location=j["location"], department=F.nullif(F.concat_ws("; ", j["department"], j["team"]), F.lit("")), published_at=D.parse_timestamp(j["publishedAt"]).cast("string"), content=j["descriptionHtml"])


def smartrecruiters(df: DataFrame) -> DataFrame:
    """``ref`` may be a text or an object with a jobAd, so it is read from the raw JSON."""
    schema = "content array<string>"
    j = F.col("j")
    at = lambda p: F.get_json_object(j, p)
    ref = F.when(at("$.ref").startswith("{"), F.coalesce(at("$.ref.jobAd.url"), at("$.ref.jobAd"))).otherwise(at("$.ref"))
    place = F.nullif(F.concat_ws(", ", at("$.location.city"), at("$.location.region"), at("$.location.country")), F.lit(""))
    return _rows(df, F.from_json("body", schema)["content"], external_id=at("$.id"), title=at("$.name"), url=F.coalesce(ref, at("$.applyUrl")), location=place, department=at("$.department.label"), published_at=D.parse_timestamp(at("$.releasedDate")).cast("string"))


def truncated(df: DataFrame) -> DataFrame:
    """Documents that announce more postings than they hold."""
    r = F.from_json("body", "totalFound int, content array<string>")
    return df.where(r["totalFound"] > F.size(r["content"]))


def feed(df: DataFrame) -> DataFrame:
    """RSS items and Atom entries. An Atom ``updated`` is never a publication date."""
    blocks = F.regexp_extract_all("body", F.lit(r"(?s)<(?:item|entry)\b.*?</(?:item|entry)>"), F.lit(0))
    j = F.col("j")
    tag = lambda t: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(j, rf"(?s)<{t}(?:\s[^>]*)?>(.*?)</{t}>", 1), r"<!\[CDATA\[|\]\]>", "")), F.lit(""))
    alt = F.nullif(F.regexp_extract(j, r"<link\b(?=[^>]*rel=\"alternate\")[^>]*href=\"([^\"]*)\"", 1), F.lit(""))
    href = F.nullif(F.regexp_extract(j, r"<link\b[^>]*href=\"([^\"]*)\"", 1), F.lit(""))
    return _rows(df, blocks, external_id=F.coalesce(tag("guid"), tag("id")), title=tag("title"), url=F.coalesce(tag("link"), alt, href), published_at=D.parse_timestamp(F.coalesce(tag("pubDate"), tag("published"))).cast("string"), content=F.coalesce(tag("description"), tag("summary")))


def sitemap_urls(df: DataFrame) -> DataFrame:
    """(…, kind, loc): child sitemaps and pages a sitemap names."""
    keep = [c for c in df.columns if c != "body"]
    locs = F.regexp_extract_all("body", F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    return df.select(*keep, F.when(F.col("body").contains("<sitemapindex"), "sitemap").otherwise("page").alias("kind"), F.explode(locs).alias("loc"))


def sitemap_walk(documents: DataFrame, root: str, depth: int = 5) -> DataFrame:
    """Pages reachable from a root sitemap: one join a level, sitemaps seen before are not taken again."""
    links = sitemap_urls(documents)
    spark = documents.sparkSession
    seen = level = spark.createDataFrame([(root,)], "url string")
    pages = links.join(level, "url", "left_semi").where("kind = 'page'").select("loc")
    for _ in range(depth):
        level = links.join(level, "url", "left_semi").where("kind = 'sitemap'").select(F.col("loc").alias("url")).distinct().join(seen, "url", "left_anti")
        seen = seen.union(level)
        pages = pages.union(links.join(level, "url", "left_semi").where("kind = 'page'").select("loc"))
    return pages.distinct()


def archive_index(df: DataFrame) -> DataFrame:
    """Rows of a header-first JSON array; bad timestamps, statuses and empty addresses are left out."""
    keep = [c for c in df.columns if c != "body"]
    rows = F.from_json("body", "array<array<string>>")
    named = F.transform(F.slice("r", F.lit(2), F.size("r")), lambda x: F.map_from_arrays(F.get("r", F.lit(0)), F.slice(x, F.lit(1), F.size(F.get("r", F.lit(0))))))
    m = df.select(*keep, rows.alias("r")).where("size(r) > 1").select(*keep, F.explode(named).alias("m"))
    at = lambda k: F.try_element_at("m", F.lit(k))
    out = m.select(*keep, F.try_to_timestamp(at("timestamp"), F.lit("yyyyMMddHHmmss")).alias("captured_at"), at("original").alias("original"), at("statuscode").alias("status"), at("digest").alias("digest"), at("mimetype").alias("mimetype"))
    return out.where(F.col("captured_at").isNotNull() & (F.coalesce("original", F.lit("")) != "") & F.col("status").rlike(r"^[0-9]{3}$")).dropDuplicates([*keep, "captured_at", "original"])


def timemap(df: DataFrame) -> DataFrame:
    """Mementos of a link-format map; no status or digest is invented."""
    keep = [c for c in df.columns if c != "body"]
    lines = F.regexp_extract_all("body", F.lit(r"<[^>]+>;[^\n]*memento[^\n]*"), F.lit(0))
    x = df.select(*keep, F.explode(lines).alias("l")).where(F.col("l").rlike(r'rel="[^"]*\bmemento\b'))
    return x.select(*keep, F.regexp_extract("l", "<([^>]+)>", 1).alias("archive_url"), D.parse_timestamp(F.regexp_extract("l", r'datetime="([^"]+)"', 1)).alias("captured_at"))


def completeness(status: Column, redirected: Column, partial: Column) -> Column:
    return F.when(redirected, 0.25).when(status != 200, 0.10).when(partial, 0.55).otherwise(0.90)


def community_posts(df: DataFrame, since: Column) -> DataFrame:
    schema = "data struct<children:array<struct<data:struct<id:string,title:string,selftext:string,permalink:string,subreddit:string,created_utc:double>>>>"
    x = df.select(F.explode(F.from_json("body", schema)["data"]["children"]).alias("c")).select("c.data.*")
    return x.withColumn("posted_at", F.timestamp_seconds(F.col("created_utc"))).where(F.col("posted_at") > since).dropDuplicates(["id"])


def json_ld(html: Column) -> Column:
    """Texts of a page's JSON-LD blocks."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))


def page_postings(df: DataFrame) -> DataFrame:
    """Postings of a page by the first route that finds any: JSON-LD, then anchors below a job path."""
    keep = [c for c in df.columns if c != "body"]
    item = "struct<title:string,url:string>"
    ld = F.filter(F.transform(json_ld(F.col("body")), lambda b: F.from_json(b, "`@type` string, title string, url string")), lambda j: (j["@type"] == "JobPosting") & j["title"].isNotNull())
    ld = F.transform(ld, lambda j: F.struct(j["title"].alias("title"), j["url"].alias("url"))).cast(f"array<{item}>")
    tags = F.regexp_extract_all("body", F.lit(r'(?is)<a\b[^>]*href="[^"]*/(?:jobs?|careers?|positions?|openings?)/[^"]+"[^>]*>.*?</a>'), F.lit(0))
    static = F.transform(tags, lambda t: F.struct(F.trim(F.regexp_replace(t, "(?s)<[^>]*>", "")).alias("title"), F.regexp_extract(t, r'href="([^"]*)"', 1).alias("url")))
    found = df.select(*keep, ld.alias("ld"), F.filter(static, lambda s: s["title"] != "").cast(f"array<{item}>").alias("st"))
    route = F.when(F.size("ld") > 0, "json_ld").when(F.size("st") > 0, "static_html").otherwise("none")
    return found.select(*keep, route.alias("route"), F.explode_outer(F.when(F.size("ld") > 0, F.col("ld")).otherwise(F.col("st"))).alias("p")).select(*keep, "route", "p.title", "p.url").dropDuplicates([*keep, "url"])


def robots_rules(df: DataFrame) -> DataFrame:
    """(…, agent, allow, pattern): rules of each group, every agent line of a group heads all its rules."""
    keep = [c for c in df.columns if c != "body"]
    lines = F.filter(F.transform(F.split("body", r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", ""))), lambda x: x.rlike(r"(?i)^(user-agent|allow|disallow)\s*:"))
    pair = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, r"^([^:]+):", 1))).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)).alias("v")))
    kind = "struct<agents:array<string>,open:boolean,out:array<struct<agent:string,allow:boolean,pattern:string>>>"

    def step(a: Column, x: Column) -> Column:
        agent = x["k"] == "user-agent"
        fresh = F.when(a["open"], F.concat(a["agents"], F.array(F.lower(x["v"])))).otherwise(F.array(F.lower(x["v"])))
        add = F.transform(a["agents"], lambda g: F.struct(g.alias("agent"), (x["k"] == "allow").alias("allow"), x["v"].alias("pattern")))
        return F.when(agent, F.struct(fresh.alias("agents"), F.lit(True).alias("open"), a["out"].alias("out"))).otherwise(F.struct(a["agents"].alias("agents"), F.lit(False).alias("open"), F.concat(a["out"], add).alias("out"))).cast(kind)

    zero = F.struct(F.array().cast("array<string>").alias("agents"), F.lit(False).alias("open"), F.array().cast("array<struct<agent:string,allow:boolean,pattern:string>>").alias("out")).cast(kind)
    return df.select(*keep, F.explode(F.aggregate(pair, zero, step, lambda a: a["out"])).alias("r")).select(*keep, "r.*").where("pattern <> ''")


def robots_allowed(rules: DataFrame, paths: DataFrame, agent: str, by: list[str]) -> DataFrame:
    """Whether an agent may fetch each path: its own group or else the general one; the longest match
    decides, a tie allows, and no match allows."""
    named = rules.where(F.col("agent") == agent.lower())
    general = rules.where(F.col("agent") == "*").join(named.select(*by).distinct(), by, "left_anti")
    chosen = named.unionByName(general)
    like = F.concat(F.lit("^"), F.replace(F.replace(F.regexp_replace("pattern", r"([.+?()\[\]{}^|\\])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("\\$"), F.lit("$")))
    hit = paths.join(chosen, by, "left").withColumn("_m", F.coalesce(F.regexp_like("path", like), F.lit(False)))
    best = F.max_by("allow", F.when(F.col("_m"), F.struct(F.octet_length("pattern"), "allow")))
    return hit.groupBy(*by, "path").agg(F.coalesce(best, F.lit(True)).alias("allowed"))
