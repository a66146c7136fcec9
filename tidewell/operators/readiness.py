"""Preparation milestones ahead of a forecast window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base and least lead days of each action.
POLICY = (("networking", 63, 28), ("referral", 49, 21), ("portfolio", 35, 14), ("resume", 28, 14), ("high_alert", 7, 3))
SIZE_SHIFT = {"startup": -7, "small": -3, "medium": 0, "large": 5, "enterprise": 9, "unknown": 0}


def adjustment(size: Column, scale: Column, competitiveness: Column, width: Column, confidence: Column) -> Column:
    """Days to start earlier (or later), between -10 and 35."""
    shift = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SIZE_SHIFT.items() for x in kv]), size), F.lit(0))
    total = (
        shift + F.rint((scale - 0.5) * 14) + F.rint((competitiveness - 0.5) * 18)
        + F.least(F.lit(18), F.ceil(F.greatest(F.lit(0), width - 14) / 7) * 3) + F.least(F.lit(16), F.ceil(F.greatest(F.lit(0.0), 70 - confidence) / 5) * 2)
    )
    return F.least(F.lit(35), F.greatest(F.lit(-10), total)).cast("int")


def plan(forecasts: DataFrame, as_of: Column, needs_portfolio: Column) -> DataFrame:
    """A row for each forecast and action: when it is due, today where that has passed. Forecasts
    whose window has ended have no plan. The five-row policy is exploded from a literal, not joined."""
    policy = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(b).alias("base"), F.lit(m).alias("least")) for a, b, m in POLICY])
    live = forecasts.where(F.col("window_end") >= as_of).withColumn("p", F.explode(policy)).where((F.col("p.action") != "portfolio") | needs_portfolio)
    width = F.datediff("window_end", "window_start")
    days = F.greatest(F.col("p.least"), F.col("p.base") + adjustment(F.col("size"), F.col("scale"), F.col("competitiveness"), width, F.col("confidence")))
    due = F.date_sub("window_start", days)
    return live.select("forecast_id", F.col("p.action").alias("action"), days.alias("lead_days"), F.greatest(due, as_of).alias("due_on"), (due < as_of).alias("overdue"))
