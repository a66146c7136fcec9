"""Postings of career pages by the first route that finds any: linked data, embedded data, links.

A page's JSON is walked as VARIANT values, level by level, so a posting may lie at any depth; a level is a job over
what is left of all pages, and there are as many as the deepest page has. Pages whose scripts cannot be parsed are
told by ``diagnostics`` and go on to the next route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import pages as P
from tidewell.session import materialize

#: Types of scripts, the key that makes a node a posting, where a place has its parts and where it nests.
LINKED, EMBEDDED = ("application/ld+json",), ("application/json", "application/ld+json; charset=utf-8")
POSTING = "JobPosting"
PLACE = ("addressLocality", "city", "addressRegion", "region", "addressCountry", "country")
NESTED = ("address", "jobLocation", "location")
#: Places are followed so deep inside each other: a list of places with addresses.
DEEP = 2


def scripts(html: Column) -> Column:
    """array<struct<type, body>> of a page's typed scripts."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*\btype\s*=.*?</script\s*>"), F.lit(0))
    kind = lambda s: F.lower(F.trim(F.regexp_extract(s, r"(?is)^<script\b[^>]*?\btype\s*=\s*[\"']?([^\"'>]*)", 1)))
    body = lambda s: F.regexp_replace(s, r"(?is)^<script\b[^>]*>|</script\s*>$", "")
    return F.transform(found, lambda s: F.struct(kind(s).alias("type"), body(s).alias("body")))


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def _text(v: Column, *paths: str) -> Column:
    """The first of the named fields that is neither missing nor empty, as text."""
    return F.coalesce(*[F.nullif(F.trim(F.try_variant_get(v, f"$.{p}", "string")), F.lit("")) for p in paths])


def place(v: Column, deep: int = DEEP) -> Column:
    """A place's text: itself, its name, its parts, the place inside it, or those of a list."""
    plain = F.nullif(F.trim(F.try_variant_get(v, "$", "string")), F.lit(""))
    name = F.when(_is(_at(v, "name"), "STRING"), _text(v, "name"))
    parts = F.array_join(F.array_distinct(F.filter(F.array(*[_text(v, p) for p in PLACE]), lambda x: x.isNotNull())), ", ")
    some = lambda all_of: F.filter(F.transform(all_of, lambda x: place(x, deep - 1)), lambda x: x.isNotNull())
    inside = [F.nullif(parts, F.lit(""))] + ([F.get(some(F.array(*[_at(v, p) for p in NESTED])), F.lit(0))] if deep else [])
    listed = some(F.try_variant_get(v, "$", "array<variant>")) if deep else F.array().cast("array<string>")
    return F.when(_is(v, "STRING"), plain).when(_is(v, "OBJECT"), F.coalesce(name, *inside)).when(_is(v, "ARRAY"), F.nullif(F.array_join(listed, " · "), F.lit("")))


def nodes(roots: DataFrame, name: str = "v") -> DataFrame:
    """``roots`` with every object inside the VARIANT column ``name``, at any depth, one a row."""
    spark, level, found = roots.sparkSession, materialize(roots, "level"), []
    others = [c for c in roots.columns if c != name]
    while not level.isEmpty():
        found.append(level.where(_is(F.col(name), "OBJECT")))
        below = level.lateralJoin(spark.tvf.variant_explode(F.col(name).outer()))
        level = materialize(below.select(*others, F.col("value").alias(name)).where(_is(F.col(name), "OBJECT") | _is(F.col(name), "ARRAY")), "level")
    out = found[0] if found else level
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def diagnostics(pages: DataFrame) -> DataFrame:
    """(page_id, type, problem) of scripts that should hold JSON and do not."""
    told = pages.select("page_id", F.explode(scripts(F.col("html"))).alias("s")).where(F.col("s.type").isin(*LINKED, *EMBEDDED))
    return told.where(F.try_parse_json("s.body").isNull()).select("page_id", F.col("s.type").alias("type"), F.lit("malformed_json").alias("problem"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, route, title, url, apply_url, company, location, employment_type) of each posting; a page without one has a row with route none.

    ``pages``: page_id, url, company, html."""
    base = pages.select("page_id", F.col("url").alias("base"), F.col("company").alias("owner"), "html")
    told = base.select("page_id", "base", "owner", F.explode(scripts(F.col("html"))).alias("s"))
    parsed = told.where(F.col("s.type").isin(*LINKED, *EMBEDDED)).select("page_id", "base", "owner", F.col("s.type").isin(*LINKED).alias("linked"), F.try_parse_json("s.body").alias("v"))
    every = nodes(parsed.where(F.col("v").isNotNull()))
    v = F.col("v")
    see = lambda c: P.joined_url(F.col("base"), c)
    kind = F.when(_is(F.try_variant_get(v, "$['@type']", "variant"), "ARRAY"), F.array_contains(F.try_variant_get(v, "$['@type']", "array<string>"), POSTING)).otherwise(F.try_variant_get(v, "$['@type']", "string") == POSTING)
    source = _text(v, "url", "sameAs")
    contact = _at(v, "applicationContact")
    apply_to = F.when(_is(contact, "OBJECT"), _text(v, "applicationContact.url")).otherwise(_text(v, "applicationContact"))
    linked = every.where(F.col("linked") & F.coalesce(kind, F.lit(False))).select(
        "page_id", F.lit("json_ld").alias("route"), _text(v, "title", "name").alias("title"), see(source).alias("url"), see(F.coalesce(apply_to, source)).alias("apply_url"),
        F.coalesce(_text(v, "hiringOrganization.name"), "owner").alias("company"), F.coalesce(place(_at(v, "jobLocation")), place(_at(v, "applicantLocationRequirements"))).alias("location"), place(_at(v, "employmentType"), 1).alias("employment_type"),
    )
    goal = _text(v, "applyUrl", "apply_url", "jobUrl", "url")
    embedded = every.where(~F.col("linked")).select(
        "page_id", F.lit("embedded_data").alias("route"), _text(v, "title", "jobTitle").alias("title"), see(F.coalesce(_text(v, "jobUrl", "url"), goal)).alias("url"), see(goal).alias("apply_url"),
        F.coalesce(_text(v, "company", "companyName"), "owner").alias("company"), place(_at(v, "location")).alias("location"), _text(v, "employmentType", "commitment").alias("employment_type"),
    )
    data = materialize(linked.unionByName(embedded).where(F.col("title").isNotNull() & F.col("url").isNotNull() & F.col("apply_url").isNotNull()), "data")
    first = data.where("route = 'json_ld'")
    second = data.where("route = 'embedded_data'").join(first.select("page_id").distinct(), "page_id", "left_anti")
    rest = base.join(data.select("page_id").distinct(), "page_id", "left_anti").select("page_id", "owner", F.explode_outer(P.postings(F.col("base"), F.col("html"))).alias("p"))
    none = F.lit(None).cast("string")
    third = rest.select(
        "page_id", F.when(F.col("p").isNull(), "none").otherwise("static_html").alias("route"), "p.title", "p.url", F.col("p.url").alias("apply_url"), F.when(F.col("p").isNotNull(), F.col("owner")).alias("company"), none.alias("location"), none.alias("employment_type")
    )
    return first.unionByName(second).unionByName(third)
