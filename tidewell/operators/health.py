"""Collection health: streaks, yields, growth, fingerprints, integrity counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def failure_streak(calls: DataFrame, by: list[str], at: str, key: str, failed: Column, detail: str) -> DataFrame:
    """For each ``by``: failures since the last success, newest first, and the newest call's detail.
    One window gives the rank; the streak is the rank of the first success less one."""
    newest = Window.partitionBy(*by).orderBy(F.col(at).desc(), F.col(key).desc())
    ranked = calls.withColumns({"_f": failed, "_r": F.row_number().over(newest)})
    first_ok = F.min(F.when(~F.col("_f"), F.col("_r")))
    return ranked.groupBy(*by).agg(F.coalesce(first_ok - 1, F.count("*")).cast("bigint").alias("streak"), F.max(F.when(F.col("_r") == 1, F.col(detail))).alias("latest"), F.max(at).alias("latest_at"))


def daily_rows(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table, day, rows) over several tables: each is counted by day before the union."""
    parts = [t.groupBy(F.to_date(c).alias("day")).agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "day", "rows") for n, (t, c) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def growth(daily: DataFrame) -> DataFrame:
    """Mean rows of each table's complete days: the first and the last day seen are not complete."""
    span = daily.groupBy("table_name").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    inner = daily.join(span, "table_name").where((F.col("day") > F.col("lo")) & (F.col("day") < F.col("hi")))
    return inner.groupBy("table_name").agg(F.count("*").alias("active_days"), F.round(F.avg("rows"), 3).alias("rows_per_day"))


def ordered_fingerprint(rows: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """md5 of each group's rows in order, fields joined by | and rows by comma. Nulls count as empty
    (concat_ws alone would drop them and give two different rows one text)."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return rows.groupBy(by).agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda s: s["t"]), ",")).alias("fingerprint"))


def table_hash(df: DataFrame) -> DataFrame:
    """Count and order-insensitive hash of a table: for checking a restored copy."""
    return df.agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*df.columns)).alias("hash"))


def decision_metrics(decisions: DataFrame, run: str, changed: Column, escalated: Column) -> DataFrame:
    """Per run: pages, changed, decided without escalation, its share in percent (null for none)."""
    return decisions.groupBy(run).agg(F.count("*").alias("pages"), F.count_if(changed).alias("changed"), F.count_if(changed & ~escalated).alias("deterministic"), F.count_if(changed & escalated).alias("escalations")).withColumn(
        "deterministic_percent", F.round(100 * F.try_divide(F.col("deterministic").cast("double"), F.col("changed").cast("double")), 2)
    )


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, violations): rows that break each rule, zero where it holds."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("violations")).select(F.lit(n).alias("check_name"), "violations") for n, df in checks.items()])
