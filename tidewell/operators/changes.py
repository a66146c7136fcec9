"""Keyed upserts, change capture, versions and state derived from append-only logs.

There is no transactional table format here, so a mutation is a function from the
stored rows and the incoming ones to the rows to store: one full outer join on the
key, with the outcome of each row as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame, incoming: DataFrame, key: str, hash_col: str, seen_col: str) -> DataFrame:
    """Rows to store with ``outcome``: created, changed (first sight kept), unchanged (only seen again), kept."""
    a, b = stored.alias("a"), incoming.alias("b")
    j = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    old, new = F.col(f"a.{key}").isNotNull(), F.col(f"b.{key}").isNotNull()
    outcome = F.when(~old, "created").when(~new, "kept").when(F.col(f"a.{hash_col}").eqNullSafe(F.col(f"b.{hash_col}")), "unchanged").otherwise("changed")
    return j.select(
        F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), F.when(outcome.isin("created", "changed"), F.col(f"b.{hash_col}")).otherwise(F.col(f"a.{hash_col}")).alias(hash_col),
        F.coalesce(F.col(f"a.{seen_col}"), F.col(f"b.{seen_col}")).alias("first_seen"), F.coalesce(F.col(f"b.{seen_col}"), F.col(f"a.{seen_col}")).alias("last_seen"), outcome.alias("outcome"),
    )


def longest_per_key(rows: DataFrame, key: str, text: str, seq: str) -> DataFrame:
    """In-batch dedupe: the longest text of a key, the first among equals, and how many there were."""
    w = Window.partitionBy(key)
    return rows.withColumns({"_r": F.row_number().over(w.orderBy(F.length(text).desc(), F.col(seq))), "copies": F.count("*").over(w)}).where("_r = 1").drop("_r")


def diff(before: DataFrame, after: DataFrame, key: str, owner: str, values: list[str]) -> DataFrame:
    """Change feed between two snapshots: inserted, deleted, moved (a row for each owner), updated; equal rows give none."""
    a, b = before.alias("a"), after.alias("b")
    j = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    same = F.lit(True)
    for c in values:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    moved = F.col(f"a.{key}").isNotNull() & F.col(f"b.{key}").isNotNull() & ~F.col(f"a.{owner}").eqNullSafe(F.col(f"b.{owner}"))
    rec = lambda side, kind: F.struct(F.col(f"{side}.{owner}").alias("owner"), F.lit(kind).alias("change"))
    none = F.array().cast("array<struct<owner:bigint,change:string>>")
    rows = (
        F.when(F.col(f"a.{key}").isNull(), F.array(rec("b", "inserted")))
        .when(F.col(f"b.{key}").isNull(), F.array(rec("a", "deleted")))
        .when(moved, F.array(rec("a", "moved_out"), rec("b", "moved_in")))
        .when(~same, F.array(rec("b", "updated")))
        .otherwise(none)
    )
    return j.select(F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), F.explode(rows).alias("c")).select(key, "c.owner", "c.change")


def versions(rows: DataFrame, key: str, at: str, seq: str, value: str) -> DataFrame:
    """Append-only versions: a row only where the value differs from the one before; runs of equal
    values are verified until the next change."""
    w = Window.partitionBy(key).orderBy(at, seq)
    changed = rows.withColumn("_new", ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1))
    numbered = changed.withColumn("version", F.sum(F.col("_new").cast("int")).over(w))
    return numbered.groupBy(key, "version").agg(F.first(value).alias(value), F.min(at).alias("valid_from"), F.max(at).alias("last_verified"), F.count("*").alias("confirmations"))


def material_changes(forecasts: DataFrame, key: str, at: str, seq: str) -> DataFrame:
    """Consecutive forecasts that differ materially: confidence by a point, the date or a bound by three days."""
    w = Window.partitionBy(key).orderBy(at, seq)
    prev = lambda c: F.lag(c).over(w)
    d = forecasts.withColumns({
        "d_confidence": F.round(F.col("confidence") - prev("confidence"), 3), "d_date": F.datediff("expected_on", prev("expected_on")),
        "d_bound": F.greatest(F.abs(F.datediff("window_start", prev("window_start"))), F.abs(F.datediff("window_end", prev("window_end")))),
    })
    reasons = F.filter(F.array(
        F.when(F.abs("d_confidence") >= 1.0, "confidence"), F.when(F.abs("d_date") >= 3, "date"), F.when(F.col("d_bound") >= 3, "interval"),
    ), lambda r: r.isNotNull())
    return d.withColumn("reasons", F.array_join(reasons, ",")).where("reasons <> ''")


def evidence_rows(forecasts: DataFrame, key: str, ids: str, weight: str) -> DataFrame:
    """One row for each cited id, the weight shared out and held between 0 and 1."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(weight) / F.size(ids)))
    return forecasts.where(F.size(ids) > 0).select(key, F.explode(ids).alias("evidence_id"), F.round(share, 6).alias("weight"))


def held_state(log: DataFrame, key: str, at: str, seq: str, action: str) -> DataFrame:
    """State from an append-only log of disable, enable and withdraw: the last entry decides, except
    that enabling lifts a hold and never what was withdrawn."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col(seq).desc())
    last = log.withColumn("_r", F.row_number().over(w))
    return last.groupBy(key).agg(F.max(F.when(F.col("_r") == 1, F.col(action))).alias("last_action"), F.max((F.col(action) == "withdraw").cast("int")).alias("_w")).select(
        key, F.when(F.col("_w") == 1, "withdrawn").when(F.col("last_action") == "disable", "held").otherwise("active").alias("state")
    )


def new_items(seen: DataFrame, baseline_before: Column, key: str, item: str, at: str) -> DataFrame:
    """First sights of an item after its source's baseline."""
    firsts = seen.groupBy(key, item).agg(F.min(at).alias("first_at"))
    return firsts.where(F.col("first_at") >= baseline_before)


def trim(rows: DataFrame, text: str, keep: int, out_of_scope: Column) -> DataFrame:
    """Shorten the long text of rows that are out of scope."""
    return rows.withColumn(text, F.when(out_of_scope & (F.char_length(text) > keep), F.left(F.col(text), F.lit(keep))).otherwise(F.col(text)))
