"""Ordered rules that a window or a fold expresses: capture states, merged windows, feeds, bands."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest gap of a bounded opening, days within which candidates merge, feed rule.
BOUNDED_GAP = 120
MERGE_DAYS = 75
FEED_SPAN, FEED_MOST = 5, 2


def visibility_openings(captures: DataFrame, by: list[str], at: str, state: str) -> DataFrame:
    """Openings and closings from captures in state present, absent or unknown. Unknown says nothing.
    absent -> present opens: bounded when the gap is at most BOUNDED_GAP days, else observed_by;
    a first present is observed_by; the next absent closes it."""
    told = captures.where(F.col(state) != "unknown")
    w = Window.partitionBy(*by).orderBy(at)
    prev, prev_at = F.lag(state).over(w), F.lag(at).over(w)
    flagged = told.withColumns({"_opens": (F.col(state) == "present") & (prev.isNull() | (prev == "absent")), "_gone": F.when(prev == "absent", prev_at)})
    closes = F.min(F.when(F.col(state) == "absent", F.col(at))).over(w.rowsBetween(1, Window.unboundedFollowing))
    o = flagged.withColumn("_closed", closes).where("_opens")
    earliest = F.date_add("_gone", 1)
    gap = F.datediff(F.col(at), earliest)
    bounded = F.col("_gone").isNotNull() & gap.between(0, BOUNDED_GAP)
    return o.select(
        *by, F.when(bounded, F.date_add(earliest, F.floor(gap / 2).cast("int"))).otherwise(F.col(at)).alias("opened_on"), F.when(bounded, "bounded").otherwise("observed_by").alias("precision"),
        F.when(bounded, earliest).alias("window_start"), F.when(bounded, F.col(at)).alias("window_end"), F.col("_closed").alias("closed_on"),
    )


def merge_candidates(events: DataFrame, key: str, on: str, rank: str, start: str, end: str) -> DataFrame:
    """Candidates of one key within MERGE_DAYS and one year of the last merged one join it: the more
    precise replaces it, two windows intersect (or span both where they do not meet). An ordered
    fold over one key's own candidates."""
    rows = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(on).alias("d"), F.col(rank).alias("p"), F.col(start).alias("s"), F.col(end).alias("e")))).alias("c"))
    kind = "array<struct<d:date,p:int,s:date,e:date,n:int>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (F.abs(F.datediff(x["d"], last["d"])) <= MERGE_DAYS) & (F.year(x["d"]) == F.year(last["d"]))
        one = lambda d, p, s, e, n: F.struct(d.alias("d"), p.alias("p"), s.alias("s"), e.alias("e"), n.alias("n"))
        s, e = F.greatest(x["s"], last["s"]), F.least(x["e"], last["e"])
        meet = s <= e
        both = one(last["d"], last["p"], F.when(meet, s).otherwise(F.least(x["s"], last["s"])), F.when(meet, e).otherwise(F.greatest(x["e"], last["e"])), last["n"] + 1)
        merged = F.when(x["p"] > last["p"], one(x["d"], x["p"], x["s"], x["e"], last["n"] + 1)).when((x["p"] == last["p"]) & (x["p"] == 1), both).otherwise(one(last["d"], last["p"], last["s"], last["e"], last["n"] + 1))
        alone = F.array(one(x["d"], x["p"], x["s"], x["e"], F.lit(1)))
        return F.when(F.size(acc) == 0, alone).when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(merged))).otherwise(F.concat(acc, alone))

    folded = rows.select(key, F.aggregate("c", F.array().cast(kind), lambda a, x: step(a, x).cast(kind)).alias("m"))
    return folded.select(key, F.inline("m")).select(key, F.col("d").alias("opened_on"), F.col("p").alias("rank"), F.col("s").alias("window_start"), F.col("e").alias("window_end"), F.col("n").alias("merged"))


def change_kind(captures: DataFrame, by: list[str], at: str, key: str, hash_col: str, usable: Column) -> DataFrame:
    """first_observed, unchanged or meaningful_change against the usable capture before."""
    w = Window.partitionBy(*by).orderBy(at, key)
    prev = F.lag(hash_col).over(w)
    return captures.where(usable).withColumn("change_kind", F.when(F.row_number().over(w) == 1, "first_observed").when(prev.eqNullSafe(F.col(hash_col)), "unchanged").otherwise("meaningful_change"))


def bands(rows: DataFrame, order: list[Column], key: Column, parts: list[str]) -> DataFrame:
    """Run-length groups of equal keys in list order, numbered inside each ``parts`` group."""
    w = Window.partitionBy(*parts).orderBy(*order)
    marked = rows.withColumn("band_key", key)
    return marked.withColumn("_n", F.when(F.col("band_key").eqNullSafe(F.lag("band_key").over(w)), 0).otherwise(1)).withColumn("band", F.sum("_n").over(w)).drop("_n")


def interleave(feed: DataFrame, company: str, newest: list[Column]) -> DataFrame:
    """A feed in which no company has more than FEED_MOST of any FEED_SPAN neighbours before an item:
    the next newest item that fits is taken; ``place`` is null for those left over. Sequential by
    nature, so it is for the bounded newest part of a feed that the caller has already limited."""
    kind = feed.withColumn("place", F.lit(None).cast("int"))

    def weave(pdf: pd.DataFrame) -> pd.DataFrame:
        rest, out = list(range(len(pdf))), []
        names = pdf[company].tolist()
        while rest:
            recent = [names[i] for i in out[-FEED_SPAN:]]
            fits = next((i for i in rest if recent.count(names[i]) < FEED_MOST), None)
            if fits is None:
                break
            out.append(fits)
            rest.remove(fits)
        place = pd.Series([None] * len(pdf), dtype="Int32")
        for n, i in enumerate(out):
            place.iloc[i] = n
        pdf = pdf.copy()
        pdf["place"] = place.values
        return pdf

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = [p for p in parts if len(p)]
        if whole:
            yield weave(pd.concat(whole, ignore_index=True))

    return feed.orderBy(*newest).coalesce(1).mapInPandas(run, kind.schema)


def sliding_limit(hits: DataFrame, key: str, at: Column, period: int, limit: int) -> DataFrame:
    """Hits of a key in the period that ends at each, and whether they are within the limit."""
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-(period - 1), 0)
    return hits.withColumn("in_period", F.count("*").over(w)).withColumn("allowed", F.col("in_period") <= limit)


def systematic_sample(rows: DataFrame, by: list[str], order: list[str], limit: int) -> DataFrame:
    """Every n/limit-th row of each group in order: an even sample, not a random one."""
    w = Window.partitionBy(*by)
    r = rows.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    slot = lambda i: F.floor(i * limit / F.col("_n"))
    return r.where((F.col("_n") <= limit) | (F.col("_i") == 0) | (slot(F.col("_i")) != slot(F.col("_i") - 1))).drop("_i", "_n")
