"""Resolving postings into recurring roles."""

from __future__ import annotations

import difflib
import functools
import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as T

#: Score weights, acceptance score and margin, words of a description that say nothing.
WEIGHTS = {"title": 0.30, "description": 0.25, "location": 0.15, "season": 0.10, "specialization": 0.10, "alias": 0.10}
ACCEPT, MARGIN = 0.72, 0.06
PLAIN_WORDS = ("and", "the", "with", "for", "our", "you", "will", "are", "this", "that", "from", "job", "role", "team", "company", "equal", "opportunity", "employer", "apply")
#: Places that are compatible with every other.
BROAD = ("unspecified", "multi_location", "united_states")
KEYS = ("company", "stated", "title", "level", "family", "season", "location", "about")


def location_scope(location: Column) -> Column:
    """A place as it is compared: a broad scope, or its words."""
    words = F.array_join(F.regexp_extract_all(F.lower(location), F.lit("[a-z0-9]+"), F.lit(0)), " ")
    return (
        F.when(location.isNull() | (location == ""), "unspecified").when(words.contains("remote"), "remote").when(words.rlike("united states| usa | us |nationwide"), "united_states")
        .when(words.rlike("multiple|various|global|worldwide"), "multi_location").otherwise(words)
    )


def features(postings: DataFrame) -> DataFrame:
    """Columns a posting is compared by. ``postings``: posting_id, company, title, description, location, first_seen.
    A null company or title is an empty one, so no posting is lost."""
    t = F.coalesce("title", F.lit(""))
    words = F.regexp_extract_all(F.lower(F.coalesce("description", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    tokens = F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*PLAIN_WORDS) & ~w.rlike("^(19|20)[0-9]{2}$"))))
    return postings.select(
        "posting_id", T.normalize_company(F.coalesce("company", F.lit(""))).alias("company"), F.array_join(T.stated_types(t), " ").alias("stated"), T.normalize_title(t).alias("title"), T.title_level(t).alias("level"),
        T.family(t).alias("family"), T.recruiting_season(t).alias("season"), location_scope(F.col("location")).alias("location"), F.array_join(tokens, " ").alias("about"), "first_seen",
    )


@functools.lru_cache(maxsize=1 << 16)
def _ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def _place(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if {a, b} & {"unspecified", "multi_location"}:
        return 0.75
    return 0.45 if {a, b} == {"remote", "united_states"} else _ratio(a, b) * 0.5


def _rest(p, r) -> float | None:
    """The score of a posting and a role but for the titles' likeness; None where a rule forbids the match.
    Stated types are equal already: they are part of the block."""
    if p["level"] != r["level"] and "unknown" not in (p["level"], r["level"]):
        return None
    if p["family"] != r["family"] and "other" not in (p["family"], r["family"]):
        return None
    if p["season"] != r["season"] and "unknown" not in (p["season"], r["season"]):
        return None
    place = _place(p["location"], r["location"])
    if place < 0.5 and p["location"] not in BROAD and r["location"] not in BROAD:
        return None
    x, y = p["words"], r["words"]
    about = len(x & y) / len(x | y) if x and y else 0.5
    w = WEIGHTS
    # Equal or unknown seasons agree, and titles state no specialization that could differ.
    return w["description"] * about + w["location"] * place + w["season"] + w["specialization"] + w["alias"] * (p["title"] in r["titles"])


def _best(p, roles) -> tuple[float, int, float]:
    """Score and place of the best role (of ties the earliest) and its lead over the next one.
    A role that cannot come within MARGIN of the best decides nothing, so its titles are not compared."""
    first, at, second = 0.0, -1, None
    known = [(rest, i) for i, r in enumerate(roles) if (rest := _rest(p, r)) is not None]
    for rest, i in sorted(known, key=lambda k: (-k[0], k[1])):
        if at >= 0 and rest + WEIGHTS["title"] < first - MARGIN:
            break
        s = rest + WEIGHTS["title"] * max(_ratio(p["title"], t) for t in roles[i]["titles"])
        if at < 0 or s > first or (s == first and i < at):
            first, at, second = s, i, first if at >= 0 else None
        elif second is None or s > second:
            second = s
    return first, at, 1.0 if second is None else first - second


def resolve(described: DataFrame) -> DataFrame:
    """(posting_id, company, role_key, score, created). Roles come into being as postings are read in
    order of (first_seen, posting_id), each scored against the roles there are. Postings of two companies or
    of other stated types never share a role, so (company, stated types) are the blocks that spread over
    the cluster; inside one the reading is sequential by definition. Postings equal in all that is compared
    follow the first of them, so a block's length is its distinct postings and not its rows."""
    keys = list(KEYS)
    distinct = described.groupBy(*keys).agg(F.min(F.struct("first_seen", "posting_id")).alias("lead"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        roles: list[dict] = []
        out = []
        pdf = pdf.sort_values(["first_seen", "posting_id"], kind="stable")
        for p in pdf.to_dict("records"):
            p["words"] = frozenset(p["about"].split())
            best, at, lead = _best(p, roles)
            if at >= 0 and best >= ACCEPT and lead >= MARGIN:
                r = roles[at]
                r["titles"].add(p["title"])
                r["season"] = p["season"] if r["season"] == "unknown" else r["season"]
                out.append((r["key"], round(best, 6), False))
            else:
                key = hashlib.sha256("|".join(p[k] for k in keys).encode()).hexdigest()[:16]
                roles.append({"key": key, "titles": {p["title"]}, **{k: p[k] for k in ("level", "family", "season", "location", "words")}})
                out.append((key, round(best, 6), True))
        pdf = pdf[keys].copy()
        pdf["role_key"], pdf["score"], pdf["created"] = [o[0] for o in out], [o[1] for o in out], [o[2] for o in out]
        return pdf

    flat = distinct.select(*keys, F.col("lead.first_seen").alias("first_seen"), F.col("lead.posting_id").alias("posting_id"))
    schema = ", ".join(f"{k} string" for k in keys) + ", role_key string, score double, created boolean"
    resolved = flat.groupBy("company", "stated").applyInPandas(run, schema)
    return described.join(resolved, keys).select("posting_id", "company", "role_key", "score", "created")
