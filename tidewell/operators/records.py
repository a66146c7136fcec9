"""Rules on stored records: what counts, what is withdrawn, what moves, and how records are told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as T

#: Phrases of bot challenges and the characters in which they are looked for, and the namespace of signal ids.
CHALLENGES = ("cf-chl-", "checking your browser before accessing", "verify you are human", "captcha challenge", "unusual traffic from your computer network", "access denied reference number")
CHALLENGE_CHARS = 20_000
SIGNAL_NAMESPACE = "ed97b6c7-e00c-4b45-81d8-17e558db0696"


def literal_match(shown: Column, wanted: Column) -> Column:
    """Whether a search occurs in a text as it stands: no character of it is a wildcard."""
    return F.instr(F.lower(shown), F.lower(F.trim(wanted))) > 0


def replay_summary(openings: DataFrame, role: str, precision: str) -> DataFrame:
    """One row: roles with two openings or more, those of them only ever observed, and the other
    roles' targets by precision (their newest exact or bounded opening). ``openings`` has one row an
    opening, with its date ``opened_on`` and key ``event_id``."""
    scoreable = F.col(precision).isin("exact", "bounded")
    newest = F.max_by(precision, F.when(scoreable, F.struct("opened_on", (-F.col("event_id")).alias("e"))))
    each = openings.groupBy(role).agg(F.count("*").alias("n"), F.count_if(scoreable).alias("scoreable"), F.when(F.count_if(scoreable) > 0, newest).alias("target")).where("n >= 2")
    return each.agg(
        F.count("*").alias("roles_with_history"), F.count_if(F.col("scoreable") == 0).alias("observed_by_only"), F.count("target").alias("candidates"),
        F.count_if(F.col("target") == "exact").alias("exact_candidates"), F.count_if(F.col("target") == "bounded").alias("bounded_candidates"),
    )


def tallies(rows: DataFrame, facets: list[str]) -> DataFrame:
    """(facet, value, items): how many rows have each value of each facet, in one pass."""
    counted = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in facets])))
    return counted.groupBy("facet", "value").agg(F.count("*").alias("items"))


def contribution_totals(rows: DataFrame, by: list[str], weight: Column, rationale: str) -> DataFrame:
    """Rows, weight and whether one rationale explains all, for each contribution."""
    return rows.groupBy(*by).agg(F.count("*").alias("receipts"), F.round(F.sum(weight), 6).alias("weight"), (F.min(rationale).eqNullSafe(F.max(rationale))).alias("uniform"))


def identity_splits(observed: DataFrame, role: str, observation: str, title: str) -> DataFrame:
    """(role, stated, observations, title, keeps): the groups of a role whose observations state different early-career
    types. The largest group keeps the role; of ties one that states a type, then the first by name. A group's title
    is its most frequent one, of ties the longest, then the last in order."""
    stated = F.array_join(T.stated_types(F.coalesce(title, F.lit(""))), " ")
    named = observed.groupBy(role, stated.alias("stated"), F.coalesce(title, F.lit("")).alias("title")).agg(F.count(observation).alias("n"))
    groups = named.groupBy(role, "stated").agg(F.sum("n").alias("observations"), F.max_by("title", F.struct("n", F.char_length("title"), "title")).alias("title"))
    order = F.struct((-F.col("observations")).alias("n"), (F.col("stated") == "").alias("none"), "stated")
    roles = groups.groupBy(role).agg(F.count("*").alias("groups"), F.min_by("stated", order).alias("kept")).where("groups > 1")
    return groups.join(roles, role).select(role, "stated", "observations", "title", (F.col("stated") == F.col("kept")).alias("keeps"))


def signal_identity(source: Column, kind: Column, url: Column, claimed: Column, event: Column, snippet: Column) -> Column:
    """sha256 of what makes two signals one: nulls are empty, a snippet is compared by its folded words."""
    field = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    folded = F.trim(F.regexp_replace(F.lower(field(snippet)), r"\s+", " "))
    return F.sha2(F.concat_ws("|", *[field(c) for c in (source, kind, url, claimed, event)], folded), 256)


def meaningful_hash(text: Column) -> Column:
    """sha256 of the set of a text's folded lines: their order and repeats say nothing. A null text is an empty one."""
    lines = F.array_except(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\r\n|\n|\r"), F.array(F.lit("")))
    return F.sha2(F.array_join(F.array_sort(lines), "\n"), 256)


def challenge(html: Column) -> Column:
    """The first phrase of a bot challenge in the head of a page; null where it is the page asked for."""
    head = F.substring(F.trim(F.regexp_replace(F.lower(html), r"\s+", " ")), 1, CHALLENGE_CHARS)
    return F.coalesce(*[F.when(F.contains(head, F.lit(p)), p) for p in CHALLENGES])


def published(stated: Column, observed: Column) -> Column:
    """struct<published_at, rejected>: a stated publication time, rejected where it has no zone or lies after the observation."""
    zoned = stated.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    at = F.try_to_timestamp(F.when(zoned, stated))
    reason = F.when(stated.isNull(), None).when(~zoned, "no_time_zone").when(at.isNull(), "unreadable").when(at > observed, "after_observation")
    return F.struct(F.when(reason.isNull(), at).alias("published_at"), reason.alias("rejected"))


def demoted(captures: DataFrame, fetches: DataFrame, source: str, partial: str) -> DataFrame:
    """Captures of a source whose latest fetch was degraded count as partial: they can show presence, not absence.
    ``fetches``: source, fetched_at, fetch_id, degraded."""
    last = fetches.groupBy(source).agg(F.max_by("degraded", F.struct("fetched_at", "fetch_id")).alias("_bad"))
    j = captures.join(last, source, "left")
    bad = F.coalesce("_bad", F.lit(False))
    return j.withColumns({"demoted": bad & ~F.col(partial), partial: F.col(partial) | bad}).drop("_bad")


def fetch_state(fetches: DataFrame, source: str) -> DataFrame:
    """Of a log of fetches (fetched_at, fetch_id, complete, content_hash): the latest one's state, and the hash of the latest complete one."""
    at = F.struct("fetched_at", "fetch_id")
    return fetches.groupBy(source).agg(F.count("*").alias("fetches"), F.max_by("complete", at).alias("complete"), F.max_by("content_hash", F.when(F.col("complete"), at)).alias("last_content_hash"))


def trimmable(postings: DataFrame, matches: DataFrame, roles: DataFrame, posting: str, role: str) -> DataFrame:
    """Postings that are matched, but to no role whose scope is in_scope or ambiguous."""
    live = matches.join(roles.where("scope in ('in_scope', 'ambiguous')"), role, "left_semi")
    return postings.join(matches, posting, "left_semi").join(live, posting, "left_anti")


def cursors(passes: DataFrame, source: str) -> DataFrame:
    """Where each source's cursor stands: the latest pass without a failure, and how many passes came after it."""
    last = passes.groupBy(source).agg(F.max(F.when(F.col("failures") == 0, F.col("passed_on"))).alias("cursor_on"))
    after = F.col("cursor_on").isNull() | (F.col("passed_on") > F.col("cursor_on"))
    return passes.join(last, source).groupBy(source).agg(F.first("cursor_on").alias("cursor_on"), F.count_if(after).alias("behind"))


def month_window(as_of: Column) -> tuple[Column, Column]:
    """The rest of a day's month."""
    return as_of, F.last_day(as_of)


def latest_outcomes(runs: DataFrame, cases: DataFrame) -> DataFrame:
    """(event_id, role_id, year, outcome, reason) of every target that the latest run scored or skipped.

    ``runs``: run_id, finished_at, created_at, metrics (JSON with skipped_targets; a run may have several such rows);
    ``cases``: run_id, event_id, role_id, year. A target both scored and skipped counts as scored."""
    latest = runs.orderBy(F.desc("finished_at"), F.desc("created_at"), "run_id").limit(1).select("run_id")
    scored = cases.join(latest, "run_id", "left_semi").select("event_id", "role_id", "year").distinct()
    item = "array<struct<target_event_id: bigint, role_id: bigint, target_year: int, reason: string>>"
    listed = runs.join(latest, "run_id", "left_semi").select(F.explode(F.from_json("metrics", f"skipped_targets {item}")["skipped_targets"]).alias("s"))
    skipped = listed.groupBy(F.col("s.target_event_id").alias("event_id"), F.col("s.role_id").alias("role_id"), F.col("s.target_year").alias("year")).agg(F.min("s.reason").alias("reason"))
    rest = skipped.join(scored.select("event_id"), "event_id", "left_anti")
    told = lambda df, outcome, reason: df.select("event_id", "role_id", "year", F.lit(outcome).alias("outcome"), reason.alias("reason"))
    return told(scored, "scored", F.lit(None).cast("string")).unionByName(told(rest, "skipped", F.col("reason")))


def page_of(rows: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    """One bounded page in a total order: at most 100 rows."""
    return rows.orderBy(*order).offset(max(offset, 0)).limit(min(max(limit, 0), 100))
