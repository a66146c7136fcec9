"""Closed-syncmer fingerprints of documents, built-ins only.

A text is a sequence of words. A window of ``K`` words is an anchor when the
smallest hash among its ``S``-word windows is at its first or last place; that
depends on the window's words alone, so an edit changes only the anchors whose
windows it touches. The fingerprint lists the distinct anchors in text order,
eight hex digits each. A text of fewer than ``K`` words, or whose windows are
all open, has one anchor, the hash of all its words; a text without words (null, empty, white space) has the
empty fingerprint. Likeness is the Dice coefficient of two anchor sets; two
empty fingerprints have likeness 1.

``next_in_order`` gives each row the next row in descending id, the first after
the last, without a global window: ids alone are range-partitioned and numbered.
Rows with one id are ordered by the hash of the text; rows equal in id and text
count as one document; ids are whole numbers, null ids come last; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.sqlx import indices, let, words
from tidewell.session import materialize

K = 6
S = 2
_NULL_ID = -(1 << 63)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Distinct anchors (32 bits, as int) in text order."""
    span = k - s
    low = lambda h: (h.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("int")

    def chosen(h: Column) -> Column:
        def at(i: Column) -> Column:
            first, last = F.get(h, i), F.get(h, i + span)
            inner = F.least(*[F.get(h, i + j) for j in range(1, span)])
            whole = low(F.xxhash64(*[F.get(h, i + j) for j in range(0, span + 1, s)], last))
            return F.when((F.least(first, last) <= inner), whole)

        return F.array_distinct(F.filter(F.transform(indices(F.size(h) - span), at), lambda x: x.isNotNull()))

    def of(w: Column) -> Column:
        smers = F.transform(indices(F.size(w) - (s - 1)), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(s)]))
        whole = F.array(low(F.xxhash64(F.array_join(w, " "))))
        return (
            F.when(F.size(w) == 0, F.array().cast("array<int>"))
            .when(F.size(w) < k, whole)
            .otherwise(let(let(smers, chosen), lambda a: F.when(F.size(a) > 0, a).otherwise(whole)))
        )

    return let(words(text), of)


def as_string(a: Column) -> Column:
    """Eight lowercase hex digits for each anchor."""
    return F.lower(F.array_join(F.transform(a, lambda x: F.substring(F.hex(x.cast("bigint") + F.lit((1 << 31) + (1 << 32))), 2, 8)), ""))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two arrays of distinct anchors, 1 where both are empty."""
    n = F.size(a) + F.size(b)
    return F.when(n == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / n)


def matches(a: Column, b: Column) -> Column:
    """Anchors two texts share, each with its place in either: the basis of positional matching."""
    common = F.array_intersect(a, b)
    return F.transform(common, lambda x: F.struct(x.alias("anchor"), F.array_position(a, x).alias("place_a"), F.array_position(b, x).alias("place_b")))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NULL_ID)).alias("_k"), F.xxhash64(text).alias("_h"), text.alias("_x")
    )


def next_in_order(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_k, _h, n, copies, _nk, _nh): each distinct (id, text hash), its code points, its rows and the key of the next."""
    keys = _keyed(docs, id_col, text_col).groupBy("_k", "_h", F.char_length("_x").alias("n")).agg(F.count(F.lit(1)).cast("int").alias("copies"))
    order = [F.col("_k").desc(), F.col("_h").asc()]
    ranged = materialize(
        keys.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")),
        "order",
    )
    key = F.struct("_k", "_h")
    # One row for each range partition, so the unpartitioned window is over as many rows as there are partitions.
    heads = ranged.groupBy("p").agg(F.min(F.struct("m", "_k", "_h")).alias("head"))
    whole = Window.orderBy("p")
    first = F.first("head").over(whole)
    after = heads.select("p", F.coalesce(F.lead("head").over(whole), first).alias("after"))
    inner = F.lead(key).over(Window.partitionBy("p").orderBy("m"))
    placed = ranged.select("*", inner.alias("nx")).join(F.broadcast(after), "p")
    return placed.select("_k", "_h", "n", "copies", F.coalesce(F.col("nx._k"), F.col("after._k")).alias("_nk"), F.coalesce(F.col("nx._h"), F.col("after._h")).alias("_nh"))


def fingerprint_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """Fingerprints of each text and of the text with its last third replaced.

    The last floor(n/3) code points give way to as many from the start of the
    next document (or all it has). Texts are shuffled once, equal rows as one, and
    both joins read that shuffle; the next row then sends only the
    prefix and its anchors."""
    keyed = _keyed(docs, id_col, text_col).dropDuplicates(["_k", "_h"])
    following = next_in_order(docs, id_col=id_col, text_col=text_col)
    cut = F.floor(F.col("n") / 3).cast("int")
    asked = following.select(F.col("_k").alias("_rk"), F.col("_h").alias("_rh"), F.col("_nk").alias("_k"), F.col("_nh").alias("_h"), "copies", cut.alias("_cut"))
    sent = keyed.join(asked, ["_k", "_h"]).select(
        F.col("_rk").alias("_k"), F.col("_rh").alias("_h"), "copies", F.expr("substring(_x, 1, _cut)").alias("_head"), anchors(F.col("_x"), k, s).alias("_next")
    )
    n = F.char_length("_x")
    return (
        keyed.join(sent, ["_k", "_h"])
        .select(F.when(F.col("_k") != _NULL_ID, F.col("_k")).cast(docs.schema[id_col].dataType).alias("_id"), "copies", n.cast("long").alias("n_chars"), "_x", "_next", F.concat(F.expr("substring(_x, 1, char_length(_x) - cast(floor(char_length(_x) / 3) as int))"), F.col("_head")).alias("_e"))
        .select("_id", "copies", "n_chars", "_next", F.sha2(F.col("_e"), 256).alias("edited_sha256"), anchors(F.col("_x"), k, s).alias("_a"), anchors(F.col("_e"), k, s).alias("_b"))
        .select(
            F.col("_id").alias(id_col), "n_chars", "edited_sha256", as_string(F.col("_a")).alias("fingerprint"), as_string(F.col("_b")).alias("edited_fingerprint"),
            likeness(F.col("_a"), F.col("_b")).alias("near_edited"), likeness(F.col("_a"), F.col("_next")).alias("near_next"), "copies",
        )
        .withColumn("copies", F.explode(F.sequence(F.lit(1), "copies")))
        .drop("copies")
    )
