"""Faceted, ranked and capped lists with counts of what each facet excludes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains_all_words(text: Column, query: str | None) -> Column:
    """Every word of the query is a substring of the text; no word, no condition."""
    words = F.filter(F.split(F.lower(F.trim(F.lit(query or ""))), r"\s+"), lambda w: w != "")
    return F.forall(words, lambda w: F.contains(text, w))


def any_of(c: Column, values: list | None) -> Column:
    return F.lit(True) if not values else F.coalesce(c.isin(values), F.lit(False))


def confidence_band(c: Column) -> Column:
    return F.when(c.isNull(), "none").when(c >= 75, "strong").when(c >= 60, "moderate").otherwise("limited")


def precision_class(exact: Column, bounded: Column, observed: Column) -> Column:
    return F.when(exact > 0, "exact").when(bounded > 0, "bounded").when(observed > 0, "observed_only").otherwise("none")


def flags(facts: DataFrame, **f) -> DataFrame:
    """``facts`` with one boolean for each facet; a facet without a parameter is true."""
    at_least = lambda c, v: F.lit(True) if v is None else F.coalesce(F.col(c) >= v, F.lit(False))
    precision = f.get("precision")
    kinds = {"exact": ["exact"], "exact_or_bounded": ["exact", "bounded"], "observed_only": ["observed_only"], "none": ["none"]}
    made = {
        "query": contains_all_words(F.col("search_text"), f.get("query")),
        "discipline": any_of(F.col("discipline"), f.get("disciplines")), "company": any_of(F.col("company"), f.get("companies")),
        "type": any_of(F.col("level"), f.get("levels")), "season": any_of(F.col("season"), f.get("seasons")), "year": any_of(F.col("target_year"), f.get("years")),
        "window": F.lit(True) if f.get("window_days") is None else F.coalesce(F.col("forecastable") & (F.col("days_until") <= f["window_days"]), F.lit(False)),
        "confidence": any_of(confidence_band(F.col("confidence")), f.get("bands")), "cycles": at_least("history_count", f.get("min_cycles")),
        "precision": any_of(precision_class(F.col("exact_count"), F.col("bounded_count"), F.col("observed_count")), kinds.get(precision)),
        "location": any_of(F.col("location"), f.get("locations")), "listed": F.lit(True) if not f.get("listed") else F.col("listed"), "watched": F.lit(True) if not f.get("watched") else F.col("followed"),
    }
    return facts.withColumns({f"is_{k}": v for k, v in made.items()}).withColumn("matching", reduce(lambda a, b: a & b, [F.col(f"is_{k}") for k in made]))


FACETS = ("query", "discipline", "company", "type", "season", "year", "window", "confidence", "cycles", "precision", "location", "listed", "watched")

#: Sort modes: columns with directions, each ending in the unique key.
ORDERS = {
    "opening": [("forecastable", "desc"), ("days_until", "asc"), ("confidence", "desc"), ("history_count", "desc"), ("company", "asc"), ("role_id", "asc")],
    "confidence": [("confidence", "desc"), ("days_until", "asc"), ("company", "asc"), ("role_id", "asc")],
    "history": [("history_count", "desc"), ("exact_count", "desc"), ("company", "asc"), ("role_id", "asc")],
    "company": [("company", "asc"), ("days_until", "asc"), ("role_id", "asc")],
}


def order_by(mode: str) -> list[Column]:
    return [F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_last() for c, way in ORDERS[mode]]


def ranked(flagged: DataFrame, mode: str) -> DataFrame:
    """Matching rows with their rank inside their company. The filter on rank is pushed into the
    window as a group limit, so a company's rows are cut before they are shuffled."""
    return flagged.where("matching").withColumn("company_rank", F.row_number().over(Window.partitionBy("company").orderBy(*order_by(mode))))


def page(flagged: DataFrame, mode: str = "opening", cap: int | None = 3, size: int = 25, offset: int = 0) -> DataFrame:
    """A page of the list: at most ``cap`` rows a company, in a total order."""
    rows = ranked(flagged, mode)
    rows = rows if not cap else rows.where(F.col("company_rank") <= cap)
    return rows.orderBy(*order_by(mode)).offset(max(0, offset)).limit(min(100, max(0, size)))


def summary(flagged: DataFrame, cap: int = 3) -> DataFrame:
    """One row: totals, matching, shown and collapsed by the cap, and for each facet the rows it
    excludes and the rows that would match without it. Two partial aggregates; the company
    step has one row a company."""
    others = lambda k: reduce(lambda a, b: a & b, [F.col(f"is_{x}") for x in FACETS if x != k])
    aggs = [F.count("*").alias("total"), F.count_if("matching").alias("matching"), F.count_if(F.col("matching") & F.coalesce(F.col("days_until") <= 30, F.lit(False))).alias("soon"), F.count_if(F.col("matching") & F.col("followed")).alias("followed")]
    for k in FACETS:
        aggs += [F.count_if(~F.col(f"is_{k}")).alias(f"excluded_{k}"), F.count_if(others(k)).alias(f"without_{k}")]
    per = flagged.groupBy("company").agg(*aggs)
    shown = F.sum(F.least("matching", F.lit(cap)))
    return per.agg(*[F.sum(c).alias(c) for c in per.columns if c != "company"], shown.alias("shown"), (F.sum("matching") - shown).alias("collapsed"))


def options(facts: DataFrame) -> DataFrame:
    """(facet, value, rows) of the six list facets: one scan, grouping sets."""
    names = ("discipline", "level", "season", "target_year", "company", "location")
    cols = facts.select(*[F.col(c).cast("string").alias(c) for c in names])
    sets = cols.groupingSets([[F.col(c)] for c in names], *names).agg(F.count("*").alias("rows"), *[F.grouping(c).alias(f"g_{c}") for c in names])
    facet, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in names:
        facet, value = F.when(F.col(f"g_{c}") == 0, c).otherwise(facet), F.when(F.col(f"g_{c}") == 0, F.col(c)).otherwise(value)
    return sets.select(facet.alias("facet"), value.alias("value"), "rows").where("value is not null")


def relax(summary_row: DataFrame, applied: list[str]) -> DataFrame:
    """The applied facet whose removal adds most rows, if any adds some; the first wins ties."""
    stack = F.array(*[F.struct(F.lit(k).alias("facet"), F.col(f"without_{k}").alias("rows"), F.lit(-i).alias("turn")) for i, k in enumerate(applied)])
    best = F.array_max(F.transform(stack, lambda s: F.struct(s["rows"], s["turn"], s["facet"])))
    return summary_row.select("matching", best.alias("b")).select("matching", F.when(F.col("b.rows") > F.col("matching"), F.col("b.facet")).alias("facet"), F.when(F.col("b.rows") > F.col("matching"), F.col("b.rows")).alias("rows"))
