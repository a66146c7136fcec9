"""Cycles, seasons, forecasts and their evaluation on the supplied tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewell import standins as S
from tidewell.functions import dates as D
from tidewell.operators import backtest as B
from tidewell.operators import cycles as C
from tidewell.operators import forecast as M
from tidewell.registry import query
from tidewell.session import materialize

AS_OF = "1998-01-01"
DATE = dt.date.fromisoformat(AS_OF)


def _cycled(spark, d):
    return C.assign(S.openings(spark, d))


def _collapsed(spark, d):
    return C.collapse(_cycled(spark, d))


def _scale(spark, d):
    size = F.element_at(F.array(*map(F.lit, M.SIZE_SCORES)), F.col("region_id") + 1)
    recruiting = F.when(F.col("company_id") % 3 != 0, (F.col("company_id") % 10) / 10.0)
    return S.companies(spark, d).select("company_id", M.company_scale(size, recruiting).alias("scale"))


@query("cycle_fold", S.with_sql("openings", f", {C.SQL.strip()} select event_id, role_id, cycle from cycled"))
def cycle_fold(spark, d):
    return _cycled(spark, d).select("event_id", "role_id", "cycle")


@query("cycle_collapse", S.with_sql("openings", f", {C.SQL.strip()} select role_id, cycle, event_id, opened_on, precision from collapsed"))
def cycle_collapse(spark, d):
    return _collapsed(spark, d).select("role_id", "cycle", "event_id", "opened_on", "precision")


@query(
    "circular_center",
    S.with_sql("openings", """select role_id, round((t - floor(t)) * 365.2425, 4) as center from (
    select role_id, atan2(sum(quality * sin(a)), sum(quality * cos(a))) / (2 * pi()) as t from (select *,
    (dayofyear(opened_on) - 1) / dayofyear(make_date(year(opened_on), 12, 31))::double * 2 * pi() as a from openings) group by 1)"""),
)
def circular_center(spark, d):
    o = S.openings(spark, d)
    on = F.col("opened_on")
    # In the order of the SQL's operations: halves between two places fall to one side by the last bit.
    angle = (F.dayofyear(on) - 1) / D.days_in_year(on) * 2 * F.lit(3.141592653589793)
    return o.groupBy("role_id").agg(D.rounded(D.angular_center(angle, F.col("quality")), 4).alias("center"))


@query(
    "seasonality_prior",
    S.with_sql("openings roles companies signals", f""", {C.SQL.strip()}, {M.sql(AS_OF).strip()},
    fam as (select r.family, m.* from own_m m join roles r on r.role_id = m.ask_id),
    mid0 as (select family, atan2(sum(weight * sin(day * 2 * pi() / 365.2425)), sum(weight * cos(day * 2 * pi() / 365.2425))) / (2 * pi()) as turn from fam group by 1),
    cen as (select family, raw, (dayofyear(dd) - 1) / 366.0::double * 365.2425::double as centre from (select family, (turn - floor(turn)) * 365.2425::double as raw, date '2000-01-01' + (round_even((turn - floor(turn)) * 366.0, 0)::int % 366) as dd from mid0))
    select family, round(centre, 3) as centre, round(greatest(7.0, sqrt(sum(weight * pow(least(abs(day - raw) % 365.2425, 365.2425 - abs(day - raw) % 365.2425), 2)) / sum(weight) + avg(u * u / 12))), 3) as spread,
    round(sum(weight), 3) as ess, round(avg(trust), 4) as trust, count(*) as cycles from fam join cen using (family) group by family, centre, raw"""),
)
def seasonality_prior(spark, d):
    m = M.measured(M.known(_collapsed(spark, d), DATE)).join(S.roles(spark, d).select("role_id", "family"), "role_id")
    p = M.seasonality(m, "family")
    return p.select("family", F.round("centre", 3).alias("centre"), F.round("spread", 3).alias("spread"), F.round("ess", 3).alias("ess"), F.round("trust", 4).alias("trust"), "cycles")


_FORECAST = f", {C.SQL.strip()}, {M.sql(AS_OF).strip()} "


@query("forecast_components", S.with_sql("openings roles companies signals", _FORECAST + "select ask_id as role_id, kind, count(*) as parts, round(sum(weight), 4) as weight, round(avg(spread), 3) as spread from parts group by all"))
def forecast_components(spark, d):
    p = M.components(S.roles(spark, d), _collapsed(spark, d), DATE)
    return p.groupBy("role_id", "kind").agg(F.count("*").alias("parts"), F.round(F.sum("weight"), 4).alias("weight"), F.round(F.avg("spread"), 3).alias("spread"))


def _forecasts(spark, d):
    return M.forecast(S.roles(spark, d), _collapsed(spark, d), S.signals(spark, d), _scale(spark, d), DATE)


@query("forecast_full", S.with_sql("openings roles companies signals", _FORECAST + "select * from forecasts"))
def forecast_full(spark, d):
    return _forecasts(spark, d)


@query("forecast_basis", S.with_sql("openings roles companies signals", _FORECAST + "select case when refusal is not null then 'none' when own_share >= 0.5 then 'own' else 'borrowed' end as basis, count(*) as roles, round(avg(confidence), 3) as mean_confidence from forecasts group by 1"))
def forecast_basis(spark, d):
    basis = F.when(F.col("refusal").isNotNull(), "none").when(F.col("own_share") >= 0.5, "own").otherwise("borrowed")
    return _forecasts(spark, d).groupBy(basis.alias("basis")).agg(F.count("*").alias("roles"), F.round(F.avg("confidence"), 3).alias("mean_confidence"))


@query("signal_factors", S.with_sql("signals", f"""select role_id, round(1 - exp(-s), 6) as support, round(1 - exp(-c), 6) as contradiction, round(case when s + c > 0 then 2 * least(s, c) / (s + c) else 0 end, 6) as conflict from (
    select role_id, sum(case when direction = 'support' then pull else 0 end) as s, sum(case when direction = 'contradict' then pull else 0 end) as c from (
    select *, strength * reliability * exp(-(date '{AS_OF}' - observed_on) / 45.0::double) as pull from (select distinct role_id, coalesce(evidence_id, '') as e, observed_on, kind, direction, strength, reliability from signals) where observed_on <= date '{AS_OF}') group by role_id)"""))
def signal_factors(spark, d):
    heard = S.signals(spark, d)
    asked = heard.select(F.col("role_id").alias("ask_id"), "role_id", F.lit(DATE).alias("as_of")).distinct()
    return M.signal_factors(heard, asked).select(F.col("ask_id").alias("role_id"), *[F.round(c, 6).alias(c) for c in ("support", "contradiction", "conflict")])


_CASES = f", {C.SQL.strip()}, {B.SQL.strip()} "


def _cases(spark, d):
    events = S.openings(spark, d)
    t = materialize(B.targets(_collapsed(spark, d), 1998, 2000), "targets")
    return B.cases(t, B.evidence(t, events), S.roles(spark, d), events, S.signals(spark, d), _scale(spark, d))


@query("backtest_cases", S.with_sql("openings roles companies signals", _CASES + "select * exclude (target_quality) from cases"))
def backtest_cases(spark, d):
    return _cases(spark, d).drop("target_quality")


_METRICS = "count(*) as cases, round(median(error_days), 2) as median_error, round(avg(error_days), 2) as mean_error, round(avg(covered::int), 4) as coverage, round(avg(2 * half_width), 2) as mean_width"


@query("backtest_metrics", S.with_sql("openings roles companies signals", _CASES + f"select {_METRICS} from cases where skipped is null"))
def backtest_metrics(spark, d):
    return B.metrics(_cases(spark, d))


@query("slice_metrics", S.with_sql("openings roles companies signals", _CASES + f"""select s.bucket, coalesce(m.cases, 0) as cases, median_error, mean_error, coverage, mean_width from (select unnest(['0','1','2','3','4+']) as bucket) s left join
    (select case when history >= 4 then '4+' else history::varchar end as bucket, {_METRICS} from cases where skipped is null group by 1) m using (bucket)"""))
def slice_metrics(spark, d):
    return B.sliced(_cases(spark, d))


@query("quality_slices", S.with_sql("openings roles companies signals", _CASES + f"select case when target_quality < 0.60 then 'low' when target_quality < 0.85 then 'medium' else 'high' end as bucket, {_METRICS} from cases where skipped is null group by 1"))
def quality_slices(spark, d):
    return B.metrics(_cases(spark, d).withColumn("bucket", B.quality_bucket(F.col("target_quality"))), "bucket")


@query("calibration_buckets", S.with_sql("openings roles companies signals", _CASES + "select least(4, floor(confidence / 100 * 5))::int as band, count(*) as cases, round(avg(confidence), 2) as mean_confidence, round(avg(covered::int), 4) as coverage, round(avg(confidence) / 100 - avg(covered::int), 4) as gap from cases where skipped is null group by 1"))
def calibration_buckets(spark, d):
    return B.calibration(_cases(spark, d))


@query("skip_reasons", S.with_sql("openings roles companies signals", _CASES + "select skipped as reason, count(*) as targets from cases where skipped is not null group by 1"))
def skip_reasons(spark, d):
    return _cases(spark, d).where("skipped is not null").groupBy(F.col("skipped").alias("reason")).agg(F.count("*").alias("targets"))


@query("company_timing", S.with_sql("openings roles", f""", {C.SQL.strip()} select company_id, count(*) as cycles, median(dayofyear(opened_on)) as median_day, min(opened_on) as earliest from collapsed join roles using (role_id) where precision <> 'observed_by' group by 1 having count(*) >= 2"""))
def company_timing(spark, d):
    c = _collapsed(spark, d).where("precision <> 'observed_by'").join(S.roles(spark, d).select("role_id", "company_id"), "role_id")
    return c.groupBy("company_id").agg(F.count("*").alias("cycles"), F.median(F.dayofyear("opened_on")).alias("median_day"), F.min("opened_on").alias("earliest")).where("cycles >= 2")


@query("rhythm_spread", S.with_sql("openings", """select role_id, count(distinct year(opened_on)) as years, 365 - max(gap) as spread from (
    select role_id, opened_on, coalesce(lead(doy) over w - doy, 365 - doy + min(doy) over (partition by role_id)) as gap from (select *, least(dayofyear(opened_on), 365) as doy from openings) window w as (partition by role_id order by doy, event_id))
    group by 1"""))
def rhythm_spread(spark, d):
    from pyspark.sql import Window

    o = S.openings(spark, d).withColumn("doy", F.least(F.dayofyear("opened_on"), F.lit(365)))
    w = Window.partitionBy("role_id").orderBy("doy", "event_id")
    gap = F.coalesce(F.lead("doy").over(w) - F.col("doy"), 365 - F.col("doy") + F.min("doy").over(Window.partitionBy("role_id")))
    return o.withColumn("gap", gap).groupBy("role_id").agg(F.countDistinct(F.year("opened_on")).alias("years"), (365 - F.max("gap")).alias("spread"))
