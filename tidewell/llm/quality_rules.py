"""Quality rules: counting rules and a hashed n-gram likelihood ratio, built-ins only.

``fit_log_ratio`` counts word unigrams and bigrams, hashed into ``buckets``
bins, over every document (the raw corpus) and over the trusted documents (the
target), and returns one log ratio for each bin. ``apply_rules`` gives each
document its rule columns, the mean log ratio of its n-grams and the verdict.

Defined results: a null or empty text has no words, all counts 0 and
``base_failed`` true; a text without n-grams has ``llr`` 0; repeated rows and
equal ids are judged row by row; other columns pass through when named in
``keep``. An empty corpus gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.sqlx import WORD, indices, let, words
from tidewell.session import materialize

#: Hash bins. The table of ratios is this long at every corpus size.
BUCKETS = 1 << 16
#: Mean log ratio from which a document is kept.
MIN_LLR = -0.15
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Fixed value: the characters counted as symbols.
NOT_SYMBOL = r"[^#*$%&|<>]+"


def ngram_bins(w: Column, buckets: int = BUCKETS) -> Column:
    """Bins of the word unigrams and bigrams of an array of words."""
    one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
    two = F.transform(
        indices(F.size(w) - 1),
        lambda i: F.pmod(F.xxhash64(F.get(w, i), F.get(w, i + 1)), F.lit(buckets)).cast("int"),
    )
    return F.concat(one, two)


def repeat_words(w: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found twice or more in the text."""

    def covered(hashes: Column) -> Column:
        keyed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
            hit = F.filter(F.transform(s, lambda x, j: F.when(same(j, j - 1) | same(j, j + 1), x["i"])), lambda i: i.isNotNull())
            return F.array_sort(hit)

        def cover(p: Column) -> Column:
            zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
            step = lambda a, i: F.struct((i + window).alias("end"), (a["n"] + i + window - F.greatest(a["end"], i)).alias("n"))
            return F.aggregate(p, zero, step, lambda a: a["n"])

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(keyed, lambda s: let(starts(s), cover)))

    windows = F.transform(indices(F.size(w) - (window - 1)), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))
    return let(windows, covered).cast("long")


def fit_log_ratio(docs: DataFrame, trusted_ids: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bin, ratio): log p(bin | trusted) - log p(bin | raw), add-one smoothed.

    Both counts cover every document. Trusted ids grow with the corpus, so they are never
    broadcast: a sort-merge join at every size, in which a hot id can be split because ids
    are unique on the right. At most ``buckets`` rows leave the count."""
    ids = trusted_ids.select(F.col(id_col).alias("_t")).where("_t is not null").distinct().hint("merge")
    flagged = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_x")).join(ids, F.col("_i") == F.col("_t"), "left")
    grams = flagged.select(
        F.explode(let(words(F.col("_x")), lambda w: ngram_bins(w, buckets))).alias("bin"),
        F.col("_t").isNotNull().cast("long").alias("hit"),
    )
    # Written once: the totals and the ratios both read it, and counting is the dear part.
    counts = materialize(grams.groupBy("bin").agg(F.count(F.lit(1)).alias("raw"), F.sum("hit").alias("target")), "bins")
    all_bins = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bin"))
    full = all_bins.join(counts, "bin", "left").select("bin", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    totals = full.agg(F.sum("raw").alias("raw_n"), F.sum("target").alias("target_n"))
    total = lambda c: totals.select(c).scalar()
    p = lambda c, n: F.log((F.col(c) + 1.0) / (n + F.lit(float(buckets))))
    return full.select("bin", (p("target", total("target_n")) - p("raw", total("raw_n"))).alias("ratio"))


def apply_rules(docs: DataFrame, ratios: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), buckets: int = BUCKETS, min_llr: float = MIN_LLR) -> DataFrame:
    """One row for each row of ``docs``: rule counts, ``llr``, ``base_failed``, ``kept``.

    ``ratios`` becomes one array of ``buckets`` doubles (a scalar subquery), so
    scoring needs no shuffle whatever the corpus size."""
    table = ratios.agg(F.array_sort(F.collect_list(F.struct("bin", "ratio"))).alias("t")).select(F.transform("t", lambda x: x["ratio"]).alias("t"))
    w = F.col("_w")
    n = F.size(w).cast("long")
    # The kept columns travel as one struct, so none of their names can clash.
    base = docs.select(F.struct(*keep).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_x"), words(F.col(text_col)).alias("_w")).select(
        "_row",
        n.alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("_x", NOT_SYMBOL, "")).cast("long").alias("n_symbols"),
        let(F.filter(F.split("_x", "\n"), lambda x: x.rlike(WORD)), lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"),
        repeat_words(w).alias("n_repeat_words"),
        table.scalar().alias("_r"),
        w,
    )
    total = let(F.col("_r"), lambda r: F.aggregate(ngram_bins(F.col("_w"), buckets), F.lit(0.0), lambda a, b: a + F.get(r, b)))
    scored = base.withColumn("llr", F.when(F.col("n_words") == 0, 0.0).otherwise(total / (2 * F.col("n_words") - 1)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return scored.select(
        *[F.col("_row")[c].alias(c) for c in keep], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("llr") >= min_llr)).alias("kept"), F.round("llr", 6).alias("llr"),
    )


def trusted(labels: DataFrame) -> DataFrame:
    """Ids of the documents that the labels call good and not toxic."""
    return labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select("doc_id")
