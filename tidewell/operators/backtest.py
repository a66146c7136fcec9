"""Rolling-origin evaluation: forecast each past cycle from what was known before it, cycles grouped anew for each cutoff.

A target is a collapsed cycle; it is forecast by the very model of ``forecast``, from
its role's other cycles, the company's and the family's season and the role's
signals, each as known by its cutoff. Targets meet their own role's events by role;
the seasons are running sums, so targets never meet all events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import dates as D
from tidewell.operators import cycles as C
from tidewell.operators import forecast as M
from tidewell.session import materialize

CUTOFF_DAYS = 60
BUCKETS = ("0", "1", "2", "3", "4+")


def targets(collapsed: DataFrame, first_year: int, last_year: int, cutoff_days: int = CUTOFF_DAYS) -> DataFrame:
    """One row for each cycle of the years: actual interval (null for observed-by) and cutoff."""
    half = F.ceil(F.coalesce("uncertainty", F.lit(0.0)) / 2).cast("int")
    start = F.when(F.col("precision") == "exact", F.col("opened_on")).when(F.col("precision") == "bounded", F.date_sub("opened_on", half))
    end = F.when(F.col("precision") == "exact", F.col("opened_on")).when(F.col("precision") == "bounded", F.date_add("opened_on", half))
    return collapsed.where(F.year("opened_on").between(first_year, last_year)).select(
        F.col("event_id").alias("target_id"), "role_id", F.col("cycle").alias("target_cycle"), F.col("opened_on").alias("target_on"), F.col("cycle_key").alias("target_key"),
        F.col("precision").alias("target_precision"), F.col("quality").alias("target_quality"), start.alias("actual_start"), end.alias("actual_end"),
        F.date_sub(F.coalesce(start, F.col("opened_on")), cutoff_days).alias("cutoff"),
    )


def evidence(target_rows: DataFrame, events: DataFrame) -> DataFrame:
    """(target, own event) pairs a forecaster could have seen, grouped into cycles for each target after filtering."""
    other = events.select("role_id", "event_id", "cycle_key", "opened_on", "available_on", "precision", "quality", "match", "uncertainty")
    # A held-out cycle is known by its key, or without keys by nearness in time.
    same = F.when(F.col("cycle_key").isNotNull() & F.col("target_key").isNotNull(), F.col("cycle_key") == F.col("target_key")).otherwise(F.abs(F.datediff("opened_on", "target_on")) < C.CYCLE_DAYS)
    seen = target_rows.join(other, "role_id").where((F.col("event_id") != F.col("target_id")) & ~same & (F.col("opened_on") <= F.col("cutoff")) & (F.col("available_on") <= F.col("cutoff")))
    return C.collapse(C.assign(seen, "target_id"), "target_id")


#: Why a target is left out.
OBSERVED_ONLY = "held-out opening is observed-by only and has no scoreable actual interval"
NO_EVIDENCE = "no temporal evidence was available by the forecast cutoff"
SPARSE = "sparse role history had no sourced company or role-family prior"


def cases(target_rows: DataFrame, seen: DataFrame, roles: DataFrame, events: DataFrame, signals: DataFrame, scale: DataFrame) -> DataFrame:
    """Forecast and score of each target, or the reason for leaving it out.

    ``seen`` is what ``evidence`` gives; ``events`` all openings; ``scale`` (company_id, scale)."""
    placed = target_rows.join(roles.select("role_id", "company_id"), "role_id", "left").join(scale, "company_id", "left")
    asked = placed.where("actual_start is not null").select(F.col("target_id").alias("ask_id"), "role_id", F.col("cutoff").alias("as_of"), "scale")
    # Both are read several times: written once.
    seen, stood = materialize(seen, "seen"), materialize(C.standing(events), "standing")
    lent = materialize(M.priors(asked, roles, stood), "lent")
    made = M.evaluate(asked, M.parts(asked, seen.withColumnRenamed("target_id", "ask_id"), lent), M.signal_factors(signals, asked))
    t = target_rows.join(made.withColumnRenamed("ask_id", "target_id"), "target_id", "left")
    skip = F.when(F.col("actual_start").isNull(), OBSERVED_ONLY).when(F.col("refusal") == "no_evidence", NO_EVIDENCE).when(F.col("refusal").isNotNull(), SPARSE)
    t = t.withColumn("skipped", skip)
    scored = lambda c: F.when(F.col("skipped").isNull(), c)
    return t.select(
        "target_id", "role_id", "target_on", "cutoff", "skipped", F.coalesce("n", F.lit(0)).cast("int").alias("history"), "target_quality",
        scored(F.col("expected_on")).alias("expected_on"), scored(F.col("half_width")).alias("half_width"),
        scored(D.distance_to_interval(F.col("expected_on"), F.col("actual_start"), F.col("actual_end"))).alias("error_days"),
        scored(D.overlaps(F.col("window_start"), F.col("window_end"), F.col("actual_start"), F.col("actual_end"))).alias("covered"),
        scored(F.col("confidence")).alias("confidence"),
    )


def metrics(case_rows: DataFrame, *by: str) -> DataFrame:
    """Count, median and mean error, coverage, mean width; null, not zero, where nothing was scored."""
    s = case_rows.where("skipped is null")
    return s.groupBy(*by).agg(
        F.count("*").alias("cases"), F.round(F.median("error_days"), 2).alias("median_error"), F.round(F.avg("error_days"), 2).alias("mean_error"),
        F.round(F.avg(F.col("covered").cast("int")), 4).alias("coverage"), F.round(F.avg(2 * F.col("half_width")), 2).alias("mean_width"),
    )


def history_bucket(n):
    return F.when(n >= 4, "4+").otherwise(n.cast("string"))


def quality_bucket(q):
    return F.when(q < 0.60, "low").when(q < 0.85, "medium").otherwise("high")


def sliced(case_rows: DataFrame) -> DataFrame:
    """Metrics by history bucket; buckets without cases are there, with nulls."""
    spine = case_rows.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    return spine.join(metrics(case_rows.withColumn("bucket", history_bucket(F.col("history"))), "bucket"), "bucket", "left").withColumn("cases", F.coalesce("cases", F.lit(0)))


def calibration(case_rows: DataFrame) -> DataFrame:
    """Confidence bands against coverage; empty bands are left out."""
    s = case_rows.where("skipped is null").withColumn("band", F.least(F.lit(4), F.floor(F.col("confidence") / 100 * 5)).cast("int"))
    g = s.groupBy("band").agg(F.count("*").alias("cases"), F.avg("confidence").alias("_c"), F.avg(F.col("covered").cast("int")).alias("_v"))
    return g.select("band", "cases", F.round("_c", 2).alias("mean_confidence"), F.round("_v", 4).alias("coverage"), F.round(F.col("_c") / 100 - F.col("_v"), 4).alias("gap"))


#: DuckDB: targets and cases over ``roles``, ``companies``, ``signals``, ``cycled`` and ``collapsed``; every target meets every event it may know.
SQL = f"""
targets as (select event_id as target_id, role_id, opened_on as target_on, cycle_key as target_key, quality as target_quality,
    case precision when 'exact' then opened_on when 'bounded' then opened_on - ceil(coalesce(uncertainty, 0) / 2)::int end as actual_start,
    case precision when 'exact' then opened_on when 'bounded' then opened_on + ceil(coalesce(uncertainty, 0) / 2)::int end as actual_end
    from collapsed where year(opened_on) between 1998 and 2000),
cut as (select *, coalesce(actual_start, target_on) - 60 as cutoff from targets),
asks as (select target_id as ask_id, role_id, cutoff as as_of, target_id, target_key, target_on from cut where actual_start is not null),
lenders as (
    select a.ask_id, a.as_of, 'own' as kind, a.role_id as lender, target_id, target_key, target_on from asks a
    union all select a.ask_id, a.as_of, 'company', e.role_id, null, null, null from asks a join roles r using (role_id) join roles e on {M.LENDS} e.company_id = r.company_id and e.role_id <> r.role_id
    union all select a.ask_id, a.as_of, 'family', e.role_id, null, null, null from asks a join roles r using (role_id) join roles e on {M.LENDS} e.family = r.family and e.company_id <> r.company_id),
met as materialized (select l.ask_id, l.kind, l.lender, e.event_id, e.opened_on, e.precision, e.quality, e.match, e.uncertainty, e.available_on, e.cycle_key
    from lenders l join openings e on e.role_id = l.lender and e.opened_on <= l.as_of and e.available_on <= l.as_of
        and (l.kind <> 'own' or (e.event_id <> l.target_id and not (case when e.cycle_key is not null and l.target_key is not null then e.cycle_key = l.target_key else abs(e.opened_on - l.target_on) < 300 end)))),
met_days as materialized (select *, row_number() over (partition by ask_id, kind, lender order by opened_on) as rn from (select distinct ask_id, kind, lender, opened_on from met where cycle_key is null)),
met_walk as (select ask_id, kind, lender, rn, opened_on, opened_on as anchor from met_days where rn = 1
    union all select d.ask_id, d.kind, d.lender, d.rn, d.opened_on, case when d.opened_on - w.anchor < 300 then w.anchor else d.opened_on end
    from met_walk w join met_days d on d.ask_id = w.ask_id and d.kind = w.kind and d.lender = w.lender and d.rn = w.rn + 1),
told_events as (select * from (select m.*, row_number() over (partition by m.ask_id, m.kind, m.lender, m.cycle_key, w.anchor order by m.opened_on,
        case m.precision when 'exact' then 2 when 'bounded' then 1 else 0 end desc, m.match desc, m.quality desc, m.uncertainty asc nulls last, m.available_on, m.event_id) as rn
    from met m left join met_walk w on m.cycle_key is null and w.ask_id = m.ask_id and w.kind = m.kind and w.lender = m.lender and w.opened_on = m.opened_on) where rn = 1),
own as (select ask_id, opened_on, quality, match, precision, uncertainty from told_events where kind = 'own'),
lent as (select ask_id, kind, opened_on, quality, match, precision, uncertainty from told_events where kind <> 'own'),
{M.SQL.strip()},
judged as (select t.*, a.n, a.expected_on as expected, a.half_width, a.confidence,
    case when actual_start is null then '{OBSERVED_ONLY}' when refusal = 'no_evidence' then '{NO_EVIDENCE}' when refusal is not null then '{SPARSE}' end as skipped from cut t left join answers a on a.ask_id = t.target_id),
cases as (select target_id, role_id, target_on, cutoff, skipped, coalesce(n, 0)::int as history, target_quality, expected as expected_on, half_width,
    case when skipped is null then greatest(0, actual_start - expected, expected - actual_end) end as error_days,
    case when skipped is null then greatest(expected - half_width, actual_start) <= least(expected + half_width, actual_end) end as covered,
    confidence from judged)"""
