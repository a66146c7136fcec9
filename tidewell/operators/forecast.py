"""The next opening window of each role, from its own cycles and two borrowed seasons.

Everything is columns and sums. A question asks for one role at one date; the
seasons it may borrow are those of other roles of its company, and of other
companies in its family, with its level and season, as known at that date. What a
group knew is a running sum over its days, and leaving a role (or company) out is a
subtraction, so no role is ever joined with every other."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import dates as D
from tidewell.operators import cycles as C
from tidewell.session import materialize

#: Fixed values of the model.
DECAY = 0.86
UNCERTAIN_SCALE = 21.0
LEAST_OBSERVED_BY = 90.0
PRIOR_CAP = {"company": 3.0, "family": 2.5}
PRIOR_MULTIPLIER = (1.0, 0.80, 0.55, 0.25, 0.10)
FLOOR_DAYS = (42, 32, 22, 12, 7)
SIZE_SCORES = (0.20, 0.35, 0.55, 0.75, 0.90)
#: Tasks among which the questions of one group are dealt out.
DEALT = 4
FACTOR_WEIGHTS = {"history": 0.22, "prior": 0.12, "consistency": 0.18, "quality": 0.14, "recency": 0.10, "precision": 0.08, "interval": 0.08, "scale": 0.08, "support": 0.08, "contradiction": -0.10, "conflict": -0.06}


def _clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), x))


def _steps(n: Column, values: tuple) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.least(n, F.lit(len(values) - 1)).cast("int") + 1)


def known(cycles: DataFrame, as_of: dt.date) -> DataFrame:
    """Evidence that had happened and was available."""
    return cycles.where((F.col("opened_on") <= F.lit(as_of)) & (F.col("available_on") <= F.lit(as_of)))


def effective_uncertainty(precision: Column, u: Column) -> Column:
    return F.when(precision == "observed_by", F.greatest(F.lit(LEAST_OBSERVED_BY), F.coalesce(u, F.lit(0.0)))).otherwise(F.coalesce(u, F.lit(0.0)))


def company_scale(size_score: Column, recruiting_scale: Column) -> Column:
    """The size's score, or its mean with the recruiting scale where that is known."""
    return F.when(recruiting_scale.isNull(), size_score).otherwise((size_score + recruiting_scale) / 2)


def measured(cycles: DataFrame) -> DataFrame:
    """Cycles with their place on the circle, uncertainty, trust and evidence weight."""
    u = effective_uncertainty(F.col("precision"), F.col("uncertainty"))
    base = F.greatest(F.lit(0.01), F.col("quality") * F.col("match")) / (1 + F.pow(u / UNCERTAIN_SCALE, F.lit(2.0)))
    return cycles.withColumns({"day": D.cycle_day(F.col("opened_on")), "u": u, "trust": F.col("quality") * F.col("match"), "weight": base})


def seasonality(measured_cycles: DataFrame, *by: str) -> DataFrame:
    """Prior of a group: centre (to a day), spread about the centre itself, effective size, mean trust, cycles."""
    centre = measured_cycles.groupBy(*by).agg(D.circular_center(F.col("day"), F.col("weight")).alias("raw")).where("raw is not null")
    # Two passes over rows that are already partitioned by the group.
    gap = D.circular_distance(F.col("day"), F.col("raw"))
    return (
        measured_cycles.join(centre, list(by))
        .groupBy(*by, "raw")
        .agg(F.sum(F.col("weight") * gap * gap).alias("_v"), F.sum("weight").alias("ess"), F.avg(F.col("u") * F.col("u") / 12).alias("_m"), F.avg("trust").alias("trust"), F.count("*").alias("cycles"))
        .select(*by, D.cycle_day(D.date_on_cycle(F.lit(2000), F.col("raw"))).alias("centre"), F.greatest(F.lit(7.0), F.sqrt(F.col("_v") / F.col("ess") + F.col("_m"))).alias("spread"), "ess", "trust", "cycles")
    )


_SUMS = ("n", "w", "sin", "cos", "m", "t")
_ROLE = ("company_id", "family", "level", "season")


def _as_of(changes: DataFrame, asked: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """(keys, as_of, mark): what each group's sums were at the days asked for.

    The window of a group has a row for each of its days, however many events it has."""
    days = changes.groupBy(*keys, F.col("on").alias("as_of")).agg(*[F.sum(c).alias(c) for c in _SUMS])
    points = asked.select(*keys, "as_of").distinct().select("*", *[F.lit(0).cast(days.schema[c].dataType).alias(c) for c in _SUMS])
    so_far = Window.partitionBy(*keys).orderBy("as_of")
    then = days.withColumn("asks", F.lit(False)).unionByName(points.withColumn("asks", F.lit(True)))
    return then.select(*keys, "as_of", "asks", F.struct(*[F.sum(c).over(so_far).alias(c) for c in _SUMS]).alias(mark)).where("asks").drop("asks")


def _moments(changes: DataFrame, asked: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(ask_id, name): weighted squared distance of a group's evidence at ``as_of`` from ``raw``.

    A task holds the weights of one group by day and place on the circle, both bounded by the
    calendar; questions of a group are dealt out to ``DEALT`` tasks."""
    deal = F.pmod(F.xxhash64("ask_id"), F.lit(DEALT)).cast("int")
    bins = changes.groupBy(*keys, "on", "day").agg(F.sum("w").alias("w")).where("w <> 0")
    none = lambda kind: F.lit(None).cast(kind)
    rows = bins.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("deal"), "on", "day", "w", none("string").alias("ask"), none("double").alias("raw")).unionByName(
        asked.where("raw is not null").select(*keys, deal.alias("deal"), F.col("as_of").alias("on"), none("double").alias("day"), none("double").alias("w"), F.col("ask_id").cast("string").alias("ask"), "raw")
    )

    def work(t: pa.Table) -> pa.Table:
        on = np.asarray(t["on"].cast(pa.int32()))
        is_ask = np.asarray(t["ask"].is_valid())
        asks, raw, at = t["ask"].filter(pa.array(is_ask)), np.asarray(t["raw"])[is_ask], on[is_ask]
        if not len(at):
            return pa.table({"ask": pa.array([], pa.string()), name: pa.array([], pa.float64())})
        place, where = np.unique(np.asarray(t["day"])[~is_ask], return_inverse=True)
        dates, turn = np.unique(at, return_inverse=True)
        slot = np.searchsorted(dates, on[~is_ask])  # the first date that knows it
        held = np.zeros((len(dates) + 1, len(place)))
        np.add.at(held, (slot, where), np.asarray(t["w"])[~is_ask])
        held = np.cumsum(held[:-1], axis=0)
        out = np.zeros(len(at))
        for k in range(0, len(at), 500):
            apart = np.abs(place[None, :] - raw[k : k + 500, None]) % D.YEAR
            apart = np.minimum(apart, D.YEAR - apart)
            out[k : k + 500] = (held[turn[k : k + 500]] * apart * apart).sum(1)
        return pa.table({"ask": asks, name: pa.array(out)})

    kind = asked.schema["ask_id"].dataType
    return rows.groupBy(*keys, "deal").applyInArrow(work, f"ask string, {name} double").select(F.col("ask").cast(kind).alias("ask_id"), name)


def priors(asked: DataFrame, roles: DataFrame, timed: DataFrame) -> DataFrame:
    """(ask_id, kind, day, spread, ess, trust): the company's and the family's season for each question.

    ``asked`` is (ask_id, role_id, as_of); ``timed`` has evidence with from_on and until_on."""
    told = roles.where("level <> 'unknown' and season <> 'unknown'").select("role_id", *_ROLE)
    m = measured(timed)
    angle = D.circular_angle(F.col("day"))
    value = {"n": F.lit(1).cast("bigint"), "w": F.col("weight"), "sin": F.col("weight") * F.sin(angle), "cos": F.col("weight") * F.cos(angle), "m": F.col("u") * F.col("u") / 12, "t": F.col("trust")}
    begins = m.select("role_id", F.col("from_on").alias("on"), "day", *[v.alias(c) for c, v in value.items()])
    ends = m.where("until_on is not null").select("role_id", F.col("until_on").alias("on"), "day", *[(-v).alias(c) for c, v in value.items()])
    # Written once: four groupings read the changes, two seasons the sums of all four.
    changes = materialize(begins.unionByName(ends).join(told, "role_id"), "changes")
    q = wanted = materialize(asked.join(told, "role_id"), "questions")
    groups = {"company": ["company_id", "level", "season"], "family": ["family", "level", "season"], "both": list(_ROLE), "own": ["role_id"]}
    for mark, keys in groups.items():
        wanted = wanted.join(_as_of(changes, q, keys, f"then_{mark}"), [*keys, "as_of"], "left")
    q = materialize(wanted, "asked")
    turn = F.lit(2 * 3.141592653589793)
    out = None
    for kind, away in (("company", "own"), ("family", "both")):
        left = {c: F.col(f"then_{kind}")[c] - F.coalesce(F.col(f"then_{away}")[c], F.lit(0)) for c in _SUMS}
        s = q.select("ask_id", "role_id", *_ROLE, "as_of", *[v.alias(c) for c, v in left.items()]).where((F.col("n") > 0) & (F.col("w") > 1e-9))
        s = s.where("abs(sin) >= 1e-12 or abs(cos) >= 1e-12").withColumn("raw", F.pmod(F.atan2("sin", "cos"), turn) * D.YEAR / turn)
        all_v, away_v = _moments(changes, s, groups[kind], "v"), _moments(changes, s, groups[away], "off") if away != "own" else _own_moments(changes, s)
        v = F.greatest(F.lit(0.0), F.col("v") - F.coalesce("off", F.lit(0.0)))
        spread = F.greatest(F.lit(7.0), F.sqrt(v / F.col("w") + F.greatest(F.lit(0.0), F.col("m")) / F.col("n")))
        s = s.join(all_v, "ask_id").join(away_v, "ask_id", "left")
        part = s.select("ask_id", F.lit(kind).alias("kind"), D.cycle_day(D.date_on_cycle(F.lit(2000), F.col("raw"))).alias("day"), spread.alias("spread"), F.col("w").alias("ess"), (F.col("t") / F.col("n")).alias("trust"))
        out = part if out is None else out.unionByName(part)
    return out


def _own_moments(changes: DataFrame, asked: DataFrame) -> DataFrame:
    """As ``_moments``, of a role's own evidence: its few events with its few questions."""
    own = changes.select("role_id", "on", "day", "w").join(asked.select("ask_id", "role_id", "as_of", "raw"), "role_id").where("on <= as_of")
    return own.groupBy("ask_id").agg(F.sum(F.col("w") * F.pow(D.circular_distance(F.col("day"), F.col("raw")), F.lit(2.0))).alias("off"))


def distinct_signals(signals: DataFrame) -> DataFrame:
    """One row for each evidence id of a role, and one for each meaning of signals without one.

    Signals of one evidence id that differ are an error."""
    if "evidence_id" not in signals.columns:
        signals = signals.withColumn("evidence_id", F.lit(None).cast("string"))
    told = ("observed_on", "kind", "direction", "strength", "reliability")
    same = F.struct(*told)
    named = signals.where("evidence_id is not null").groupBy("role_id", "evidence_id").agg(F.min(same).alias("s"), F.max(same).alias("z"))
    sure = F.when(F.col("s") == F.col("z"), F.col("s")).otherwise(F.raise_error(F.lit("signals of one evidence id differ")))
    return named.select("role_id", sure.alias("s")).select("role_id", "s.*").unionByName(signals.where("evidence_id is null").select("role_id", *told).distinct())


def signal_factors(signals: DataFrame, asked: DataFrame) -> DataFrame:
    """(ask_id, support, contradiction, conflict) of what each question's role signalled until then, decayed over 45 days."""
    seen = distinct_signals(signals).join(asked.select("ask_id", "role_id", "as_of"), "role_id").where("observed_on <= as_of")
    return factors(seen.groupBy("ask_id").agg(*pulls()))


def pulls() -> tuple[Column, Column]:
    """Aggregates: what signals before ``as_of`` say for and against an opening, as _s and _c."""
    pull = F.col("strength") * F.col("reliability") * F.exp(-F.datediff("as_of", "observed_on") / 45.0)
    part = lambda d: F.sum(F.when(F.col("direction") == d, pull).otherwise(0.0))
    return part("support").alias("_s"), part("contradict").alias("_c")


def factors(s: DataFrame) -> DataFrame:
    """(ask_id, support, contradiction, conflict) of each question's ``pulls``."""
    return s.select("ask_id", (1 - F.exp(-F.col("_s"))).alias("support"), (1 - F.exp(-F.col("_c"))).alias("contradiction"), F.when(F.col("_s") + F.col("_c") > 0, 2 * F.least("_s", "_c") / (F.col("_s") + F.col("_c"))).otherwise(0.0).alias("conflict"))


def parts(asked: DataFrame, own: DataFrame, lent: DataFrame) -> DataFrame:
    """(ask_id, kind, day, weight, spread, ess, trust, u, opened_on): what each forecast is made of.

    ``own`` is the collapsed evidence of each question's role, ``lent`` what ``priors`` gives."""
    dated = measured(own.join(asked.select("ask_id", "as_of"), "ask_id"))
    age = F.datediff("as_of", "opened_on") / F.lit(D.YEAR)
    none = F.lit(None)
    own_rows = dated.select("ask_id", F.lit("role_history").alias("kind"), "day", (F.pow(F.lit(DECAY), age) * F.col("weight")).alias("weight"), F.sqrt(16 + F.col("u") * F.col("u") / 12).alias("spread"), none.cast("double").alias("ess"), "trust", "u", "opened_on")
    n = own.groupBy("ask_id").agg(F.count("*").alias("n"))
    borrowed = lent.join(n, "ask_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    cap = F.when(F.col("kind") == "company", PRIOR_CAP["company"]).otherwise(PRIOR_CAP["family"])
    weight = _steps(F.col("n"), PRIOR_MULTIPLIER) * F.least(cap, F.col("ess")) * F.greatest(F.lit(0.05), F.col("trust")) * F.greatest(F.lit(0.10), F.exp(-F.col("spread") / 45))
    prior_rows = borrowed.select("ask_id", "kind", "day", weight.alias("weight"), "spread", "ess", "trust", none.cast("double").alias("u"), none.cast("date").alias("opened_on"))
    return own_rows.unionByName(prior_rows)


def evaluate(asked: DataFrame, part_rows: DataFrame, heard: DataFrame) -> DataFrame:
    """The forecast of each question, or the reason for refusing.

    ``asked`` is (ask_id, as_of, scale, ...). One shuffle by question serves the sums; the circle's
    centre is needed before its variance, so a question's own parts come as one array."""
    held = part_rows.groupBy("ask_id").agg(F.collect_list(F.struct("kind", "day", "weight", "spread", "ess", "trust", "u", "opened_on")).alias("parts"))
    mine = lambda p: p["kind"] == "role_history"
    total = lambda of, f: F.aggregate(of, F.lit(0.0), lambda a, p: a + f(p))
    turn = F.lit(6.283185307179586)
    # Sums over an array follow its order; sorting it makes them the same on every run.
    s = asked.join(held, "ask_id", "left").join(heard, "ask_id", "left")
    s = s.withColumn("parts", F.array_sort(F.coalesce("parts", F.array().cast(held.schema["parts"].dataType)))).withColumns({"own": F.filter("parts", mine), "lent": F.filter("parts", lambda p: ~mine(p))})
    s = s.withColumns({"n": F.size("own"), "W": F.when(F.size("parts") > 0, total("parts", lambda p: p["weight"])), "W_own": total("own", lambda p: p["weight"]), "scale": F.coalesce("scale", F.lit(0.5))})
    reason = F.when((F.col("n") > 0) & (F.col("n") < 3) & (F.size("lent") == 0), "sparse_history_without_prior").when(F.size("parts") == 0, "no_evidence")
    angle = lambda f: total("parts", lambda p: p["weight"] * f(D.circular_angle(p["day"])))
    s = s.withColumn("centre", F.pmod(F.atan2(angle(F.sin), angle(F.cos)), turn) * D.YEAR / turn)
    away = lambda p: F.pow(D.circular_distance(p["day"], F.col("centre")), F.lit(2.0))
    s = s.withColumn("variance", total("parts", lambda p: p["weight"] * (p["spread"] * p["spread"] + away(p))) / F.col("W"))
    s = s.withColumn("sigma", F.sqrt(F.col("variance") * (1 + 1 / F.greatest(F.lit(1.0), F.col("W")))))
    floor = F.rint(_steps(F.col("n"), FLOOR_DAYS) * (1.05 - 0.10 * F.col("scale")))
    s = s.withColumn("half_width", F.least(F.lit(90), F.greatest(floor, F.rint(1.282 * F.col("sigma")))).cast("int"))
    s = s.withColumn("expected_on", D.next_occurrence(F.col("as_of"), F.col("centre"), F.col("half_width")))
    some = F.col("n") > 0
    mean = lambda of, f: total(of, f) / F.nullif(F.size(of), F.lit(0))
    own_spread = F.when(some, F.sqrt(total("own", lambda p: p["weight"] * away(p)) / F.nullif(F.col("W_own"), F.lit(0.0)))).otherwise(F.col("sigma"))
    latest = F.array_max(F.transform("own", lambda p: p["opened_on"]))
    factor = {
        "history": 1 - F.exp(-F.col("W_own") / 3), "prior": 1 - F.exp(-total("lent", lambda p: p["ess"]) / 4), "consistency": F.exp(-own_spread / 24),
        "quality": F.when(some, mean("own", lambda p: p["trust"])).otherwise(mean("lent", lambda p: p["trust"])), "recency": F.when(some, F.exp(-F.datediff("as_of", latest) / (2 * D.YEAR))).otherwise(0.35),
        "precision": F.exp(-F.when(some, mean("own", lambda p: p["u"])).otherwise(F.col("sigma")) / 30), "interval": F.exp(-F.col("half_width") / 45), "scale": F.col("scale"),
        "support": F.coalesce("support", F.lit(0.0)), "contradiction": F.coalesce("contradiction", F.lit(0.0)), "conflict": F.coalesce("conflict", F.lit(0.0)),
    }
    s = s.withColumns({f"f_{k}": F.round(_clamp(v), 4) for k, v in factor.items()})
    raw = sum((F.col(f"f_{k}") * w for k, w in FACTOR_WEIGHTS.items()), F.lit(0.0))
    cap = F.when((F.col("n") == 0) | (F.col("W_own") <= 0.50), 0.48).when(F.col("W_own") <= 1.25, 0.56).when(F.col("W_own") <= 2.25, 0.69).when(F.col("W_own") <= 3.25, 0.82).otherwise(0.92)
    chance = F.least(cap, F.greatest(F.lit(0.05), 0.08 + 0.84 * _clamp(raw)))
    s = s.withColumn("refusal", reason).withColumn("confidence", F.round(100 * chance, 1))
    told = lambda c: F.when(F.col("refusal").isNull(), c)
    share = told(F.round(F.col("W_own") / F.col("W"), 4))
    return s.select(
        "ask_id", "n", "refusal", told(F.round("centre", 3)).alias("centre"), told(F.col("half_width")).alias("half_width"), told(F.col("expected_on")).alias("expected_on"),
        told(F.date_sub("expected_on", F.col("half_width"))).alias("window_start"), told(F.date_add("expected_on", F.col("half_width"))).alias("window_end"),
        told(F.col("confidence")).alias("confidence"), share.alias("own_share"), *[told(F.col(f"f_{k}")).alias(f"f_{k}") for k in factor],
    )


def components(roles: DataFrame, cycles: DataFrame, as_of: dt.date) -> DataFrame:
    """(role_id, kind, day, weight, ...): the parts of every role's forecast at one date, from collapsed openings."""
    asked = roles.select(F.col("role_id").alias("ask_id"), "role_id", F.lit(as_of).alias("as_of"))
    seen = materialize(known(cycles, as_of), "known")
    timed = seen.withColumns({"from_on": F.greatest("opened_on", "available_on"), "until_on": F.lit(None).cast("date")})
    lent = materialize(priors(asked, roles, timed), "lent")
    return parts(asked, seen.withColumn("ask_id", F.col("role_id")), lent).withColumnRenamed("ask_id", "role_id")


def forecast(roles: DataFrame, cycles: DataFrame, signals: DataFrame, scale: DataFrame, as_of: dt.date) -> DataFrame:
    """One row a role. ``cycles`` are collapsed openings, ``scale`` is (company_id, scale)."""
    asked = roles.join(scale, "company_id", "left").select(F.col("role_id").alias("ask_id"), "role_id", F.lit(as_of).alias("as_of"), "scale")
    part_rows = components(roles, cycles, as_of).withColumnRenamed("role_id", "ask_id")
    return evaluate(asked, part_rows, signal_factors(signals, asked)).withColumnRenamed("ask_id", "role_id")


#: DuckDB: forecasts of ``asks`` (ask_id, role_id, as_of) from ``own`` and ``lent`` events (ask_id, [kind,] and an opening's columns).
SQL = """
own_m as (select o.*, a.as_of, {measures} from own o join asks a using (ask_id)),
lent_m as (select *, {measures} from lent),
prior_mid as (select ask_id, kind, atan2(sum(weight * sin(day * 2 * pi() / 365.2425)), sum(weight * cos(day * 2 * pi() / 365.2425))) / (2 * pi()) as turn from lent_m group by all),
prior_raw as (select ask_id, kind, (turn - floor(turn)) * 365.2425::double as raw from prior_mid),
prior_sum as (select ask_id, kind, raw, greatest(7.0, sqrt(sum(weight * pow(least(abs(day - raw) % 365.2425, 365.2425 - abs(day - raw) % 365.2425), 2)) / sum(weight) + avg(u * u / 12))) as spread,
    sum(weight) as ess, avg(trust) as trust from lent_m join prior_raw using (ask_id, kind) group by all),
prior as (select *, (dayofyear(d) - 1) / 366.0::double * 365.2425::double as day from (select *, date '2000-01-01' + (round_even(raw / 365.2425 * 366.0, 0)::int % 366) as d from prior_sum)),
counted as (select ask_id, count(*) as n from own group by ask_id),
parts as (
    select ask_id, 'role_history' as kind, day, pow(0.86, (as_of - opened_on) / 365.2425::double) * weight as weight, sqrt(16 + u * u / 12) as spread, null::double as ess, trust, u, opened_on from own_m
    union all
    select p.ask_id, kind, day, [1.0, 0.80, 0.55, 0.25, 0.10][least(coalesce(n, 0), 4)::int + 1]::double * least(case kind when 'company' then 3.0 else 2.5 end, ess) * greatest(0.05, trust) * greatest(0.10, exp(-spread / 45)),
        spread, ess, trust, null, null from prior p left join counted using (ask_id)),
centres as (select ask_id, (atan2(sum(weight * sin(day * 2 * pi() / 365.2425)), sum(weight * cos(day * 2 * pi() / 365.2425))) / (2 * pi())) as turn from parts group by ask_id),
around as (select p.*, c.centre, pow(least(abs(p.day - c.centre) % 365.2425, 365.2425 - abs(p.day - c.centre) % 365.2425), 2) as off
    from parts p join (select ask_id, (turn - floor(turn)) * 365.2425::double as centre from centres) c using (ask_id)),
summed as (select ask_id, any_value(centre) as centre, count(*) filter (kind = 'role_history') as n, count(*) filter (kind <> 'role_history') as lent_n,
    sum(weight) as W, coalesce(sum(weight) filter (kind = 'role_history'), 0) as W_own, sum(weight * (spread * spread + off)) / sum(weight) as variance,
    avg(trust) filter (kind = 'role_history') as own_trust, avg(trust) filter (kind <> 'role_history') as lent_trust, coalesce(sum(ess) filter (kind <> 'role_history'), 0) as ess,
    sqrt(sum(weight * off) filter (kind = 'role_history') / sum(weight) filter (kind = 'role_history')) as own_spread,
    avg(u) filter (kind = 'role_history') as own_u, max(opened_on) as latest from around group by ask_id),
one_signal as (select distinct role_id, coalesce(evidence_id, '') as evidence_id, observed_on, kind, direction, strength, reliability from signals),
heard as (select ask_id, sum(case when direction = 'support' then pull else 0 end) as s, sum(case when direction = 'contradict' then pull else 0 end) as c from
    (select a.ask_id, direction, strength * reliability * exp(-(as_of - observed_on) / 45.0::double) as pull from one_signal join asks a using (role_id) where observed_on <= as_of) group by ask_id),
wide as (select a.ask_id, a.as_of, coalesce(s.n, 0) as n, coalesce(s.lent_n, 0) as lent_n, s.centre, s.W, coalesce(s.W_own, 0) as W_own, s.variance, coalesce(s.own_trust, s.lent_trust) as trust, coalesce(s.ess, 0) as ess, s.own_spread, s.own_u, s.latest,
    case when c.company_id % 3 = 0 then [0.20, 0.35, 0.55, 0.75, 0.90][c.region_id + 1]::double else ([0.20, 0.35, 0.55, 0.75, 0.90][c.region_id + 1]::double + (c.company_id % 10) / 10.0::double) / 2 end as scale,
    coalesce(1 - exp(-h.s), 0) as support, coalesce(1 - exp(-h.c), 0) as contradiction, coalesce(case when h.s + h.c > 0 then 2 * least(h.s, h.c) / (h.s + h.c) else 0 end, 0) as conflict
    from asks a join roles r using (role_id) join companies c using (company_id) left join summed s using (ask_id) left join heard h using (ask_id)),
with_sigma as (select *, sqrt(variance * (1 + 1 / greatest(1.0, W))) as sigma from wide),
sized as (select *, least(90, greatest(round_even([42, 32, 22, 12, 7][least(n, 4)::int + 1] * (1.05::double - 0.10::double * scale), 0), round_even(1.282 * sigma, 0)))::int as half_width from with_sigma),
this_year as (select *, {this} as this, {following} as following, {preceding} as preceding from sized),
placed as (select *, case when as_of - (case when this >= as_of then preceding else this end) <= half_width then (case when this >= as_of then preceding else this end)
    when this >= as_of then this else following end as expected_on from this_year),
factors as (select *, case when n > 0 and n < 3 and lent_n = 0 then 'sparse_history_without_prior' when n = 0 and lent_n = 0 then 'no_evidence' end as refusal,
    round(least(1, greatest(0, 1 - exp(-W_own / 3))), 4) as f_history, round(least(1, greatest(0, 1 - exp(-ess / 4))), 4) as f_prior,
    round(least(1, greatest(0, exp(-coalesce(own_spread, sigma) / 24))), 4) as f_consistency, round(least(1, greatest(0, trust)), 4) as f_quality,
    round(least(1, greatest(0, case when n > 0 then exp(-(as_of - latest) / (2 * 365.2425::double)) else 0.35 end)), 4) as f_recency,
    round(least(1, greatest(0, exp(-coalesce(own_u, sigma) / 30))), 4) as f_precision, round(exp(-half_width / 45.0::double), 4) as f_interval,
    round(scale, 4) as f_scale, round(support, 4) as f_support, round(contradiction, 4) as f_contradiction, round(conflict, 4) as f_conflict from placed),
scored as (select *, least(case when n = 0 or W_own <= 0.50 then 0.48 when W_own <= 1.25 then 0.56 when W_own <= 2.25 then 0.69 when W_own <= 3.25 then 0.82 else 0.92 end,
    greatest(0.05, 0.08 + 0.84 * least(1.0, greatest(0.0, f_history * 0.22::double + f_prior * 0.12::double + f_consistency * 0.18::double + f_quality * 0.14::double + f_recency * 0.10::double + f_precision * 0.08::double
        + f_interval * 0.08::double + f_scale * 0.08::double + f_support * 0.08::double - f_contradiction * 0.10::double - f_conflict * 0.06::double)))) as chance from factors),
answers as (select ask_id, n::int as n, refusal, {told_columns} from scored)"""


def _on_cycle(year: str) -> str:
    days = f"dayofyear(make_date({year}, 12, 31))"
    return f"make_date({year}, 1, 1) + (round_even(centre / 365.2425 * {days}, 0)::int % {days}::int)::int"


_TOLD = {
    "centre": "round(centre, 3)", "half_width": "half_width", "expected_on": "expected_on", "window_start": "expected_on - half_width", "window_end": "expected_on + half_width",
    "confidence": "round(100 * chance, 1)", "own_share": "round(W_own / W, 4)", **{f"f_{k}": f"f_{k}" for k in FACTOR_WEIGHTS},
}
_U = "(case when precision = 'observed_by' then greatest(90.0::double, coalesce(uncertainty, 0)) else coalesce(uncertainty, 0) end)"
SQL = SQL.format(
    measures=f"quality * match as trust, {_U} as u, greatest(0.01, quality * match) / (1 + pow({_U} / 21.0, 2)) as weight, (dayofyear(opened_on) - 1) / dayofyear(make_date(year(opened_on), 12, 31))::double * 365.2425::double as day",
    this=_on_cycle("year(as_of)"), following=_on_cycle("year(as_of) + 1"), preceding=_on_cycle("year(as_of) - 1"), told_columns=", ".join(f"case when refusal is null then {v} end as {k}" for k, v in _TOLD.items()),
)

#: Who lends to a role r: e is the lender's role.
LENDS = """r.level <> 'unknown' and r.season <> 'unknown' and e.level = r.level and e.season = r.season and"""


def sql(as_of: str) -> str:
    """CTEs for every role's forecast at one date, over ``roles``, ``companies``, ``signals`` and ``collapsed``."""
    return f"""
    known as (select * from collapsed where opened_on <= date '{as_of}' and available_on <= date '{as_of}'),
    asks as (select role_id as ask_id, role_id, date '{as_of}' as as_of from roles),
    own as (select role_id as ask_id, opened_on, quality, match, precision, uncertainty from known),
    lent as (select r.role_id as ask_id, 'company' as kind, k.opened_on, k.quality, k.match, k.precision, k.uncertainty from roles r
            join roles e on {LENDS} e.company_id = r.company_id and e.role_id <> r.role_id join known k on k.role_id = e.role_id
        union all select r.role_id, 'family', k.opened_on, k.quality, k.match, k.precision, k.uncertainty from roles r
            join roles e on {LENDS} e.family = r.family and e.company_id <> r.company_id join known k on k.role_id = e.role_id),
    {SQL.strip()},
    forecasts as (select * rename (ask_id as role_id) from answers)"""
