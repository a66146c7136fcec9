"""Sources and role resolution on documents made from the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import resolution as E
from tidewell.plans.texts import titles
from tidewell.registry import query
from tidewell.session import load
from tidewell.sources import structured as U


def _payloads(spark, d):
    """One document for each brand: its parts as a job board would send them."""
    p = load(spark, d, "part")
    job = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.concat(F.lit("https://jobs.example.com/"), F.col("p_partkey").cast("string")).alias("absolute_url"), F.struct(F.col("p_type").alias("name")).alias("location"),
                   F.lit("2024-03-01T10:00:00Z").alias("first_published"), F.array(F.struct(F.col("p_brand").alias("name"))).alias("departments"))
    return p.groupBy(F.col("p_brand").alias("source")).agg(F.to_json(F.struct(F.collect_list(job).alias("jobs"))).alias("body"))


@query("source_greenhouse", "select p_brand as source, p_partkey::varchar as external_id, p_name as title, 'https://jobs.example.com/' || p_partkey as url, p_type as location, p_brand as department, '2024-03-01 10:00:00' as published_at, null::varchar as content from part")
def source_greenhouse(spark, d):
    return U.greenhouse(_payloads(spark, d))


@query("source_feed", "select p_brand as source, 'g' || p_partkey as external_id, p_name as title, 'https://feed.example.com/' || p_partkey as url, '2024-05-06 07:08:09' as published_at from part")
def source_feed(spark, d):
    p = load(spark, d, "part")
    k = F.col("p_partkey").cast("string")
    item = F.concat(F.lit("<item><guid>g"), k, F.lit("</guid><title><![CDATA["), F.col("p_name"), F.lit("]]></title><link>https://feed.example.com/"), k, F.lit("</link><pubDate>Mon, 06 May 2024 07:08:09 GMT</pubDate></item>"))
    docs = p.groupBy(F.col("p_brand").alias("source")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("body"))
    return U.feed(docs).select("source", "external_id", "title", "url", "published_at")


@query("source_archive_index", "select distinct p_brand as source, timestamp '2024-01-01 00:00:00' + to_seconds(p_partkey % 1000) as captured_at, 'https://x.example.com/' || (p_partkey % 50) as original from part where p_partkey % 9 <> 0")
def source_archive_index(spark, d):
    p = load(spark, d, "part")
    k = F.col("p_partkey")
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + k % 1000), "yyyyMMddHHmmss")
    row = F.array(F.when(k % 9 == 0, "bad").otherwise(at), F.concat(F.lit("https://x.example.com/"), (k % 50).cast("string")), F.lit("200"), F.lit("D"))
    head = F.array(F.lit("timestamp"), F.lit("original"), F.lit("statuscode"), F.lit("digest"))
    docs = p.groupBy(F.col("p_brand").alias("source")).agg(F.to_json(F.concat(F.array(head), F.collect_list(row))).alias("body"))
    return U.archive_index(docs).select("source", "captured_at", "original")


@query("role_resolution")
def role_resolution(spark, d):
    p = load(spark, d, "part")
    t = titles(spark, d).join(p.select(F.col("p_partkey").alias("posting_id"), "p_type", "p_name"), "posting_id")
    return E.resolve(E.features(t.select("posting_id", "company", "title", F.col("p_name").alias("description"), F.lower("p_type").alias("location"), F.col("posting_id").alias("first_seen"))))
