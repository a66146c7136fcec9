"""Changes of several tables at once: each function gives the next version of every table it touches and the
audit rows, from one set of requests. A request that rests on a stale read is an error in the plan, whichever of the
tables is written first, so no table can move on without the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The track of a level.
TRACKED = ("internship", "new_grad", "apprenticeship")


def track(level: Column) -> Column:
    return F.when(level.isin(*TRACKED), level).otherwise("other")


def review_scopes(roles: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next roles, review rows) of decisions on roles that await one.

    ``roles``: role_id, status, reason, discipline, type, method, classified_at; ``reviews``: review_id, role_id, listed_at,
    status, reason, discipline, type, decided_at, at most one a role. A role that was classified anew since it was listed, or that
    neither is ambiguous nor was decided by a person, makes the change fail."""
    told = ("status", "reason", "discipline", "type")
    old = roles.select("role_id", F.col("classified_at").alias("_at"), F.col("status").alias("_status"), F.col("method").alias("_method"))
    fits = (F.col("_at") == F.col("listed_at")) & ((F.col("_status") == "ambiguous") | (F.col("_method") == "human_review"))
    stale = F.concat(F.lit("role "), F.col("role_id").cast("string"), F.lit(" changed since it was listed, or is not awaiting review"))
    kind = dict(reviews.dtypes)["review_id"]
    sure = reviews.join(old, "role_id", "left").withColumn("review_id", F.when(F.coalesce(fits, F.lit(False)), F.col("review_id")).otherwise(F.raise_error(stale).cast(kind))).drop("_at", "_status", "_method")
    new = sure.select("role_id", F.struct("review_id", *told, "decided_at").alias("_n"))
    hit = F.col("_n.review_id").isNotNull()
    change = {**{c: F.when(hit, F.col(f"_n.{c}")).otherwise(F.col(c)) for c in told}, "method": F.when(hit, "human_review").otherwise(F.col("method")), "classified_at": F.when(hit, F.col("_n.decided_at")).otherwise(F.col("classified_at"))}
    return roles.join(new, "role_id", "left").withColumns(change).select(roles.columns), sure


def split_roles(splits: DataFrame, moves: DataFrame, *, roles: DataFrame, matches: DataFrame, aliases: DataFrame, events: DataFrame, followers: DataFrame) -> dict[str, DataFrame]:
    """Next versions of ``roles``, ``matches``, ``aliases``, ``events`` and ``followers``, and ``audit``, after programs left merged roles.

    ``splits``: source, target, title, level, source_title, source_level (null: unchanged), one a source; ``moves``: source,
    observation_id; ``roles``: role_id, title, level, track, active, superseded_by and others that a new role inherits;
    ``matches`` and ``events``: role_id, observation_id; ``aliases``: role_id, first_observation_id; ``followers``: role_id. An
    observation that no longer belongs to its source fails the change. A source without observations is retired and its followers go on."""
    held = matches.select(F.col("role_id").alias("source"), "observation_id", F.lit(True).alias("_held"))
    left = moves.distinct().join(held, ["source", "observation_id"], "left").join(splits.select("source", "target"), "source")
    gone = F.concat(F.lit("observation "), F.col("observation_id").cast("string"), F.lit(" no longer belongs to role "), F.col("source").cast("string"))
    kind = dict(splits.dtypes)["target"]
    moved = left.select("source", "observation_id", F.when(F.col("_held"), F.col("target")).otherwise(F.raise_error(gone).cast(kind)).alias("target"))

    def shifted(table: DataFrame, observation: str) -> DataFrame:
        to = moved.select(F.col("source").alias("role_id"), F.col("observation_id").alias(observation), F.col("target").alias("_to"))
        return table.join(to, ["role_id", observation], "left")

    def done(table: DataFrame, columns: list[str]) -> DataFrame:
        return table.withColumn("role_id", F.coalesce("_to", "role_id")).select(columns)

    def count(table: DataFrame, name: str) -> DataFrame:
        return table.where("_to is not null").groupBy(F.col("role_id").alias("source")).agg(F.count(F.lit(1)).alias(name))

    m, a, e = shifted(matches, "observation_id"), shifted(aliases, "first_observation_id"), shifted(events, "observation_id")
    # One row a source: what it had, and what of it moved.
    rest = m.join(splits.select(F.col("source").alias("role_id")), "role_id", "left_semi").groupBy(F.col("role_id").alias("source")).agg(F.count_if(F.col("_to").isNull()).alias("remaining"), F.count("_to").alias("observations"), F.max("_to").alias("_sure"))
    state = splits.join(rest, "source", "left").where("observations > 0")
    state = state.withColumns({"retired": F.col("remaining") == 0, "target": F.col("_sure")})
    f = followers.join(state.where("retired").select(F.col("source").alias("role_id"), F.col("target").alias("_to")), "role_id", "left")
    audit = state.select("source", "target", "observations", "retired")
    for table, name in ((a, "aliases"), (e, "events"), (f, "followers")):
        audit = audit.join(count(table, name), "source", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    own = state.select(F.col("source").alias("role_id"), F.struct("target", "retired", "source_title", "source_level", "title", "level").alias("_s"))
    joined = roles.join(own, "role_id", "left")
    stays = F.col("_s").isNotNull() & ~F.col("_s.retired")
    renamed = F.when(stays, F.coalesce("_s.source_level", "level")).otherwise(F.col("level"))
    kept = joined.withColumns({
        "title": F.when(stays, F.coalesce("_s.source_title", "title")).otherwise(F.col("title")), "level": renamed, "track": F.when(stays & F.col("_s.source_level").isNotNull(), track(F.col("_s.source_level"))).otherwise(F.col("track")),
        "active": F.when(F.col("_s.retired"), False).otherwise(F.col("active")), "superseded_by": F.when(F.col("_s.retired"), F.col("_s.target")).otherwise(F.col("superseded_by")),
    })
    born = joined.where(F.col("_s").isNotNull()).withColumns({"role_id": F.col("_s.target"), "title": F.col("_s.title"), "level": F.col("_s.level"), "track": track(F.col("_s.level")), "active": F.lit(True), "superseded_by": F.lit(None).cast(dict(roles.dtypes)["superseded_by"])})
    return {
        "roles": kept.select(roles.columns).unionByName(born.select(roles.columns)), "matches": done(m, matches.columns), "aliases": done(a, aliases.columns), "events": done(e, events.columns), "followers": done(f, followers.columns), "audit": audit,
    }
