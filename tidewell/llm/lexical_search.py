"""Ranked lexical search over term-bucketed postings.

``postings`` counts the terms of every document where it lies and gives one row for each
document and term: bucket, term, row, document, n (the document's terms with repeats)
and tf. Each partition is sorted by bucket and term, so that a written table is read by
its column statistics and compresses well; a frequent term lies in all partitions.
Every document with a term also posts ``EVERY``, the empty term, n times: its postings
are the number of documents and of all their terms.

``search`` joins item terms with postings on (bucket, term), scores each match in whole
numbers, sums by item and document and keeps the first ``k`` by a window. A match is
summed with the document's other matches before it leaves its task, because a document's
postings lie together; Spark sends the items' terms to all tasks where their written
table is small, and else shuffles both sides by (bucket, term) and splits frequent terms.
Each task sends ``k`` documents an item to the last window.

Defined results: null and termless texts, of items too, match nothing; a repeated item
term counts each time; every row of the documents is a document and every row of the
items an item of its own, so repeated rows are ranked side by side; equal scores are
ordered by ascending id, null ids last, then by row; fewer matches give fewer rows; an
empty table on either side gives none; texts are read whole, however long. Only the
named columns are read, so others may have any name.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import materialize

K = 20
BUCKETS = 256
EVERY = ""
#: Texts counted at a time.
TEXTS = 50
#: Fixed value: a term is a run of digits, ASCII letters and everything beyond ASCII, here as bytes of UTF-8.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Fixed values of the weight: term saturation 1.2, length share 0.25, in whole numbers.
SATURATION, LENGTH_SHARE = 12, 25


def counted(text: Column) -> Column:
    """Terms of a text with their counts; ``EVERY``, the last, counts all of them. Only ASCII letters are lower-cased."""

    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))

    def some(texts: pa.Array) -> pa.Array:
        offsets, terms, counts = [0], [], []
        for one in texts:
            found = Counter(TERM.findall(one.as_py().lower())) if one.is_valid else {}
            if found:
                terms += found.keys()
                counts += found.values()
                terms.append(EVERY.encode())
                counts.append(sum(found.values()))
            offsets.append(len(terms))
        rows = pa.StructArray.from_arrays([pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], ["term", "tf"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows).cast(kind)

    @F.arrow_udf("array<struct<term: string, tf: bigint>>")
    def count(texts: pa.Array) -> pa.Array:
        # A few texts at a time, so that a worker holds few terms as objects; freed memory goes back.
        whole = texts.cast(pa.large_string()).cast(pa.large_binary())
        out = pa.concat_arrays([some(whole.slice(at, TEXTS)) for at in range(0, len(whole), TEXTS)] or [pa.array([], kind)])
        pa.default_memory_pool().release_unused()
        return out

    return count(text)


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """(bucket, term, row, doc, n, tf), sorted within partitions; only of the given ``terms`` and ``EVERY``, if any.

    ``row`` is fixed once the table is written."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc"), counted(F.col(text_col)).alias("terms"))
    n = F.element_at("terms", -1)["tf"]
    rows = numbered.where(F.size("terms") > 0).select("row", "doc", n.alias("n"), F.inline("terms"))
    rows = rows.select(bucket(F.col("term")).alias("bucket"), "term", "row", "doc", "n", "tf")
    if terms is not None:
        wanted = terms.select("term").union(docs.sparkSession.createDataFrame([(EVERY,)], "term string")).distinct()
        rows = rows.join(materialize(wanted, "terms"), "term", "left_semi").select(rows.columns)
    return rows.sortWithinPartitions("bucket", "term")


def item_terms(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(ask, item, term, times) of each row of ``items``; ``ask`` is fixed once the table is written."""
    numbered = items.select(F.monotonically_increasing_id().alias("ask"), F.col(id_col).alias("item"), counted(F.col(text_col)).alias("terms"))
    return numbered.select("ask", "item", F.inline("terms")).where(F.col("term") != EVERY).withColumnRenamed("tf", "times")


def weighted(asked: DataFrame, index: DataFrame) -> tuple[DataFrame, int, int]:
    """Item terms with bucket and weight, the number of documents with a term, and of all their terms."""
    held = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    wanted = asked.select("term").distinct().union(asked.sparkSession.createDataFrame([(EVERY,)], "term string"))
    known = materialize(held.join(wanted, "term", "left_semi"), "df")
    every = known.where(F.col("term") == EVERY).first()
    docs, occurrences = (every["df"], every["total"]) if every else (0, 0)
    weight = F.floor(F.lit(1000.0) * F.log((2.0 * F.lit(docs) + 2.0) / (2.0 * F.col("df") + 1.0))).cast("bigint")
    return asked.join(known.where(F.col("term") != EVERY).select("term", weight.alias("w")), "term").withColumn("bucket", bucket(F.col("term"))), docs, occurrences


def matches(asked: DataFrame, index: DataFrame, docs: int, occurrences: int) -> DataFrame:
    """(ask, row, doc, score): each match scored in whole numbers, summed by item and document."""
    slow = F.expr(f"{100 - LENGTH_SHARE} + ({LENGTH_SHARE} * n * {docs}L) div {max(1, occurrences)}L")
    found = index.where(F.col("term") != EVERY).join(asked.select("ask", "bucket", "term", (F.col("times") * F.col("w")).alias("w")), ["bucket", "term"])
    part = found.withColumn("m", slow).withColumn("part", F.expr(f"w * ((1000000000 * tf) div (1000 * tf + {SATURATION} * m))"))
    return part.groupBy("ask", "row", "doc").agg(F.sum("part").alias("score"))


def search(index: DataFrame, asked: DataFrame, *, k: int = K) -> DataFrame:
    """(item, rank, doc, score) of the ``k`` best documents of each item, from written postings and item terms."""
    terms, docs, occurrences = weighted(asked, index)
    scored = matches(materialize(terms, "weighed"), index, docs, occurrences).where("score > 0")
    best = Window.partitionBy("ask").orderBy(F.desc("score"), F.asc_nulls_last("doc"), "row")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(asked.select("ask", "item").distinct(), "ask").select("item", "rank", "doc", "score")
