"""Event-time windows and stateful detection for streams; the window functions also take static tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _late(df: DataFrame, at: str, watermark: str | None) -> DataFrame:
    if not (watermark and df.isStreaming):
        return df
    zoned = df if df.schema[at].dataType.typeName() == "timestamp" else df.withColumn(at, F.col(at).cast("timestamp"))
    return zoned.withWatermark(at, watermark)


def tumbling(df: DataFrame, at: str, size: str, by: list[str], value: str, watermark: str | None = "1 hour") -> DataFrame:
    w = _late(df, at, watermark).groupBy(F.window(at, size), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("start"), *by, "n", "total")


def sliding(df: DataFrame, at: str, size: str, slide: str, by: list[str], value: str, watermark: str | None = "1 hour") -> DataFrame:
    w = _late(df, at, watermark).groupBy(F.window(at, size, slide), *by).agg(F.count("*").alias("n"), F.max(value).alias("top"))
    return w.select(F.col("window.start").alias("start"), *by, "n", "top")


def sessions(df: DataFrame, at: str, gap: str, by: list[str], watermark: str | None = "1 hour") -> DataFrame:
    w = _late(df, at, watermark).groupBy(F.session_window(at, gap), *by).agg(F.count("*").alias("n"))
    return w.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def first_sights(df: DataFrame, keys: list[str], at: str, watermark: str = "7 days") -> DataFrame:
    """New items of a stream: a key seen before inside the watermark is dropped."""
    return df.withWatermark(at, watermark).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


_CHANGE = "source string, observed_at timestamp, kind string, previous string, content string"


def page_changes(pages: DataFrame) -> DataFrame:
    """Changes of each source's page in a stream of (source, observed_at, content): the state is the
    hash last seen, an unchanged page emits nothing, the first one is the baseline."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for pdf in rows:
            for r in pdf.sort_values("observed_at").itertuples():
                if last is None:
                    out.append((key[0], r.observed_at, "baseline", None, r.content))
                elif r.content != last:
                    out.append((key[0], r.observed_at, "changed", last, r.content))
                last = r.content
        if last is not None:
            state.update((last,))
        if out:
            yield pd.DataFrame(out, columns=["source", "observed_at", "kind", "previous", "content"])

    return pages.groupBy("source").applyInPandasWithState(step, _CHANGE, "content string", "append", GroupStateTimeout.NoTimeout)


def upsert_sink(target: str, key: str, order: str):
    """A foreachBatch function that keeps the newest row of each key in a Parquet folder. A batch
    replayed after a failure writes the same rows, so the sink is idempotent."""

    def write(batch: DataFrame, batch_id: int) -> None:
        from pyspark.sql import Window

        spark = batch.sparkSession
        path = f"{target}/v{batch_id:08d}"
        old = spark.read.schema(batch.schema).parquet(f"{target}/v{batch_id - 1:08d}") if batch_id else batch.limit(0)
        w = Window.partitionBy(key).orderBy(F.col(order).desc())
        old.unionByName(batch).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").write.mode("overwrite").parquet(path)

    return write
