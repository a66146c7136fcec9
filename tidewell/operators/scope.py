"""Scope of roles: what titles and the filing of their postings say, decided by ordered rules that cite evidence.

A text becomes an array of hits: group, label, and the evidence (tier, kind, rule, matched,
field) in the order in which the rules found it. Each title of a role is decided with the
filing of the postings that carried it; then the role's titles must agree. All of it is
built-in expressions but for the folding of accents. Decisions of a role are aggregated, never
gathered: a role with very many titles is no large row."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import scope_rules as R

FIELDS = ("department", "team", "function")
CATEGORY = "struct<department: string, team: string, function: string, experience_level: string>"
_HIT = "array<struct<g: string, label: string, tier: string, kind: string, rule: string, matched: string, field: string>>"
_EVIDENCE = ("tier", "kind", "rule", "matched", "field")
_EVIDENCE_TYPE = "array<struct<" + ", ".join(f"{c}: string" for c in _EVIDENCE) + ">>"


def _plain_letters(text: Column) -> Column:
    """Compatibility decomposition, which no built-in function does; then ASCII only."""

    @F.arrow_udf("string")
    def decomposed(texts: pa.Array) -> pa.Array:
        return pc.utf8_normalize(texts, form="NFKD")

    return F.regexp_replace(decomposed(text), r"[^\x00-\x7F]", "")


def fold(ascii_text: Column) -> Column:
    """Lower-case words between single blanks, a blank at both ends."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(ascii_text), F.lit("[a-z0-9+#]+"), F.lit(0)), " "), F.lit(" "))


def _none() -> Column:
    return F.array().cast(_HIT)


def _hit(group: str, label: str | Column, tier: str, kind: str, rule: str | Column, matched: Column, field: str | Column) -> Column:
    text = lambda v: v if isinstance(v, Column) else F.lit(v)
    said = F.left(F.trim(matched), F.lit(300))
    return F.struct(F.lit(group).alias("g"), text(label).alias("label"), F.lit(tier).alias("tier"), F.lit(kind).alias("kind"), text(rule).alias("rule"), said.alias("matched"), text(field).alias("field"))


def _every(text: Column, pattern: str, make) -> Column:
    """A hit for every match."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), make)


def _first(text: Column, pattern: str, make) -> Column:
    """A hit for the first match, or none."""
    found = F.regexp_extract(text, pattern, 0)
    return F.when(found != "", F.array(make(found))).otherwise(_none())


def _topics_and_functions(text: Column, tier: str, field: str | Column) -> Column:
    """Hits of the tables that titles and filings share."""
    named = [_first(text, rx, lambda m, d=d, r=r: _hit("strong", d, tier, "discipline", r, m, field)) for d, r, rx in R.STRONG]
    topics = [_first(text, rx, lambda m, d=d, r=r: _hit("topic", d, tier, "discipline", r, m, field)) for d, r, rx in R.TOPICS]
    rest = [
        _every(text, R.FUNCTION, lambda m: _hit("function", "", tier, "function", "non_technical_function", m, field)),
        _every(text, R.BOUNDARY, lambda m: _hit("boundary", "", tier, "boundary", "design_or_advocacy_boundary", m, field)),
        _every(text, R.UNLISTED, lambda m: _hit("unlisted", "", tier, "unlisted_discipline", "unlisted_technical_discipline", m, field)),
    ]
    return F.concat(*named, *topics, *rest)


def with_title_hits(rows: DataFrame, title: str, name: str) -> DataFrame:
    """``rows`` with a column ``name`` of the hits of a title."""
    staged = rows.withColumn("_text", fold(_plain_letters(F.coalesce(title, F.lit("")))))
    staged = staged.withColumn("_own", F.regexp_replace("_text", R.STAFF, " "))
    staged = staged.withColumn("_rest", F.when(F.col("_own").rlike(R.OTHER_ROLE_NOUN), F.regexp_replace("_own", R.APM_ABBREVIATION, " ")).otherwise(F.col("_own")))
    text, rest = F.col("_text"), F.col("_rest")
    say = lambda g, kind, rule, label="": lambda m: _hit(g, label, "title", kind, rule, m, "title")
    hits = [
        F.when(text.rlike(R.NAVIGATION) & text.rlike(R.NAVIGATION_PLURAL), F.array(say("navigation", "navigation", "navigation_label")(text))).otherwise(_none()),
        _first(text, R.CONTENT_LABEL, say("navigation", "navigation", "content_label")),
        _every(text, R.STAFF, say("function", "function", "early_career_program_staff")),
        _every(rest, R.CONTRACT, say("contract", "employment", "contract_or_temporary")),
        *[_first(rest, rx, say("type", "early_career", rule, kind)) for kind, rule, rx in R.TYPE_RULES],
        _first(F.regexp_replace(rest, R.NEW_GRAD, " "), R.BARE_GRADUATE, say("type", "early_career", "graduate", "graduate_program")),
        _every(rest, R.GENERIC_EARLY_CAREER, say("generic", "early_career", "generic_early_career")),
        _every(rest, R.SENIORITY, say("seniority", "seniority", "seniority")),
        _every(F.regexp_replace(rest, R.PRODUCT_OR_PROGRAM_MANAGER, " "), R.MANAGER, say("manager", "seniority", "manager")),
        _first(rest, R.TECH_NOUN, say("noun", "", "")),
        _topics_and_functions(rest, "title", "title"),
    ]
    return staged.withColumn(name, F.concat(*hits)).drop("_text", "_own", "_rest")


def _filed(text: Column, field: Column) -> Column:
    """Hits of a department, team or function."""
    word = F.regexp_extract(text, R.ATS_EARLY_CAREER, 0)
    kind = F.when(word.rlike(r"^co ") | word.contains("coop"), "co_op").when(word.contains("intern"), "internship").otherwise("new_grad")
    generic = (kind == "new_grad") & ~word.rlike("new grad|graduate")
    early = F.when(word == "", _none()).when(generic, F.array(_hit("generic", "", "ats_category", "early_career", "generic_early_career", word, field))).otherwise(F.array(_hit("type", kind, "ats_category", "early_career", kind, word, field)))
    return F.concat(early, _topics_and_functions(text, "ats_category", field))


def _category(item: Column) -> Column:
    """Hits of one filing: its fields, then its experience level, which replaces the same type."""
    fields = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), item[f].alias("text")) for f in FIELDS]), lambda f: f["text"] != "")
    found = F.flatten(F.transform(fields, lambda f: _filed(fold(f["text"]), f["field"])))
    level = F.lower(F.trim(F.coalesce(item["experience_level"], F.lit(""))))
    stated = F.when(level == "internship", F.array(_hit("type", "internship", "ats_category", "early_career", "internship", level, "experience_level"))).when(
        level == "entry_level", F.array(_hit("type", "new_grad", "ats_category", "early_career", "entry_level", level, "experience_level"))
    )
    senior = F.when(level.isin(*R.ATS_SENIOR_LEVELS), F.array(_hit("seniority", "", "ats_category", "seniority", "seniority", level, "experience_level"))).otherwise(_none())
    same = lambda h: (h["g"] == "type") & (h["label"] == stated[0]["label"])
    typed = F.when(stated.isNull(), found).when(F.exists(found, same), F.transform(found, lambda h: F.when(same(h), stated[0]).otherwise(h))).otherwise(F.concat(found, stated))
    return F.concat(typed, senior)


def _employment(kind: Column) -> Column:
    """Hits of an employment type."""
    text = fold(kind)
    stated = lambda label: lambda m: _hit("type", label, "ats_category", "early_career", label, m, "employment_type")
    contract = _every(text, R.CONTRACT, lambda m: _hit("contract", "", "ats_category", "employment", "contract_or_temporary", m, "employment_type"))
    return F.concat(contract, F.when(text.rlike(R.CO_OP), _first(text, R.CO_OP, stated("co_op"))).otherwise(_first(text, R.INTERNSHIP, stated("internship"))))


def with_filing_hits(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with a column ``name`` of the hits of how the postings of a title are filed: categories first, then employment types."""
    parts = (*FIELDS, "experience_level")
    letters = F.array_join(F.transform("categories", lambda c: F.concat_ws("\x1f", *[F.coalesce(c[f], F.lit("")) for f in parts])), "\x1e")
    bare = F.transform(F.split(_plain_letters(letters), "\x1e"), lambda s: F.split(s, "\x1f"))
    filed = F.when(F.size("categories") > 0, F.transform(bare, lambda p: F.struct(*[p[i].alias(f) for i, f in enumerate(parts)])))
    worked = F.when(F.size("employment_types") > 0, F.split(_plain_letters(F.array_join("employment_types", "\x1e")), "\x1e"))
    staged = rows.withColumns({"_filed": filed, "_worked": worked})
    by_category = F.flatten(F.transform(F.coalesce("_filed", F.array().cast(f"array<{CATEGORY}>")), _category))
    by_work = F.flatten(F.transform(F.filter(F.coalesce("_worked", F.array().cast("array<string>")), lambda e: F.trim(e) != ""), _employment))
    return staged.withColumn(name, F.concat(by_category, by_work)).drop("_filed", "_worked")


def _of(hits: Column, *groups: str) -> Column:
    return F.filter(hits, lambda h: h["g"].isin(*groups))


def _firsts(hits: Column, group: str) -> Column:
    """The first hit of each label of a group."""
    own = _of(hits, group)
    labels = F.transform(own, lambda h: h["label"])
    return F.filter(own, lambda h, i: F.array_position(labels, h["label"]) == i + 1)


def _ranked(hits: Column, order: tuple[str, ...]) -> Column:
    """Hits of different labels, by a fixed order of the labels."""
    return F.flatten(F.transform(F.array(*map(F.lit, order)), lambda label: F.filter(hits, lambda h: h["label"] == label)))


def _label(hits: Column, *labels: str) -> Column:
    return F.filter(hits, lambda h: h["label"].isin(*labels))


def _some(hits: Column) -> Column:
    return F.size(hits) > 0


def with_decision(rows: DataFrame, title: str, filing: str, name: str) -> DataFrame:
    """``rows`` with a column ``name``: status, reason, discipline, type and evidence, by the first rule that applies."""
    t, a = F.col(title), F.col(filing)
    stated = rows.withColumn("_source", F.when(_some(_of(t, "type", "generic")), t).otherwise(a)).withColumn("_types", _firsts(F.col("_source"), "type"))
    intern = _some(_label(F.col("_types"), "co_op", "internship"))
    yields = lambda h: ((h["label"] == "graduate_program") & (h["rule"] == "graduate")) | ((h["label"] == "new_grad") & h["rule"].isin("associate_product_manager_program", "junior"))
    stated = stated.withColumn("_types", F.filter("_types", lambda h: ~(intern & yields(h))))
    types, generic = F.col("_types"), F.slice(_of(F.col("_source"), "generic"), 1, 1)
    kind = F.coalesce(F.get(_ranked(types, R.TYPES), F.lit(0))["label"], F.when(_some(generic), "new_grad"))
    both = (kind == "internship") & _some(_label(types, "rotational"))
    why = F.when(~_some(types), generic).when(both, _ranked(types, ("internship", "rotational"))).otherwise(types)
    strong, topics = _firsts(t, "strong"), _firsts(t, "topic")
    filed_strong, filed_topics = _firsts(a, "strong"), _firsts(a, "topic")
    named = F.transform(filed_strong, lambda h: h["label"])
    filed = F.concat(filed_strong, F.filter(filed_topics, lambda h: ~F.array_contains(named, h["label"])))
    own = F.when(_some(strong), strong).when(_some(_of(t, "noun")), topics).otherwise(_none())
    stated = stated.withColumns({"_kind": kind, "_why": why, "_strong": strong, "_own": own}).withColumn("_filed", filed)
    kind, why, strong, own, filed = (F.col(c) for c in ("_kind", "_why", "_strong", "_own", "_filed"))
    at_once, later = _ranked(types, ("co_op", "internship")), _ranked(types, ("graduate_program", "new_grad"))
    listed = _ranked(F.when(_some(own), own).otherwise(filed), R.DISCIPLINES)
    rules = [
        (_some(_of(t, "navigation")), "out_of_scope", "not_a_role", _of(t, "navigation"), False),
        (_some(_of(t, "contract")) | _some(_of(a, "contract")), "out_of_scope", "contract_or_temporary", F.concat(_of(t, "contract"), _of(a, "contract")), False),
        (_some(at_once) & _some(later), "ambiguous", "early_career_type_conflict", F.concat(at_once, later), False),
        (kind.isNull() & (_some(_of(t, "seniority", "manager")) | _some(_of(a, "seniority"))), "out_of_scope", "senior_role", F.concat(_of(t, "seniority"), _of(t, "manager"), _of(a, "seniority")), False),
        (kind.isNull(), "out_of_scope", "not_early_career", _none(), False),
        (_some(_of(t, "seniority")) | _some(_of(a, "seniority")), "ambiguous", "seniority_conflict", F.concat(why, _of(t, "seniority"), _of(a, "seniority")), True),
        (_some(_of(t, "function")) & ~_some(strong), "out_of_scope", "non_technical_function", F.concat(why, _of(t, "function")), True),
        (_some(_of(t, "function")) & F.forall(strong, lambda h: h["rule"].isin(*R.BOUNDARY_RULES)), "ambiguous", "function_and_discipline_conflict", F.concat(why, strong, _of(t, "function")), True),
        (~_some(strong) & _some(_of(t, "boundary")), "ambiguous", "design_or_advocacy_boundary", F.concat(why, _of(t, "boundary")), True),
        (_some(strong) & _some(_of(t, "unlisted")), "ambiguous", "discipline_conflict", F.concat(why, strong, _of(t, "unlisted")), True),
        (~_some(own) & _some(_of(t, "unlisted")), "out_of_scope", "unlisted_technical_discipline", F.concat(why, _of(t, "unlisted")), True),
        (~_some(own) & ~_some(filed) & _some(_of(a, "function")), "out_of_scope", "non_technical_function", F.concat(why, _of(a, "function")), True),
        (~_some(own) & ~_some(filed), "ambiguous", "discipline_unknown", why, True),
        (F.lit(True), "in_scope", "in_scope", F.concat(why, listed), True),
    ]
    outcome, evidence = F.when(F.lit(False), F.lit(-1)), F.when(F.lit(False), _none())
    for i, (applies, _, _, cited, _) in enumerate(rules):
        outcome, evidence = outcome.when(applies, F.lit(i)), evidence.when(applies, cited)
    stated = stated.withColumns({"_rule": outcome, "_cited": evidence})
    told = lambda values: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), F.col("_rule") + 1)
    plain = F.slice(F.array_distinct(F.transform("_cited", lambda h: F.struct(*[h[c].alias(c) for c in _EVIDENCE]))), 1, R.EVIDENCE)
    status = told([r[1] for r in rules])
    decision = F.struct(
        status.alias("status"), told([r[2] for r in rules]).alias("reason"), F.when(status == "in_scope", F.get(listed, F.lit(0))["label"]).alias("discipline"),
        F.when(F.element_at(F.array(*[F.lit(r[4]) for r in rules]), F.col("_rule") + 1), kind).alias("type"), plain.alias("evidence"),
    )
    return stated.withColumn(name, decision).drop("_source", "_types", "_kind", "_why", "_strong", "_own", "_filed", "_rule", "_cited")


def classify(titles: DataFrame) -> DataFrame:
    """(role_id, status, reason, discipline, type, evidence) of each role.

    ``titles``: role_id, ord (distinct in a role), title, categories (array of department, team, function,
    experience_level), employment_types. Blank titles say nothing, nor does their filing. When every title is out of
    scope the first one's reason stands; titles that disagree otherwise are an alias conflict."""
    blank = F.coalesce(F.trim("title"), F.lit("")) == ""
    said = F.when(~blank, F.col("title"))
    rows = titles.select("role_id", "ord", blank.alias("blank"), said.alias("title"), F.when(~blank, F.col("categories")).alias("categories"), F.when(~blank, F.col("employment_types")).alias("employment_types"))
    # Each distinct title, and each distinct filing, is scanned once.
    t = with_title_hits(rows.where(~F.col("blank")).select("title").distinct(), "title", "t")
    a = with_filing_hits(rows.where(~F.col("blank")).select("categories", "employment_types").distinct(), "a")
    scanned = rows.join(t, "title", "left").join(a, ["categories", "employment_types"], "left")
    scanned = scanned.select("role_id", "ord", "blank", F.coalesce("t", _none()).alias("t"), F.coalesce("a", _none()).alias("a"))
    decided = with_decision(scanned, "t", "a", "d")
    of = F.struct("d.status", "d.reason", "d.discipline", "d.type")
    told = decided.select("role_id", "ord", "blank", of.alias("of"), F.posexplode_outer("d.evidence").alias("pos", "e"))
    counts = F.when(~F.col("blank"), F.col("of"))
    cited = told.groupBy("role_id", "e").agg(
        F.min(F.struct("ord", "pos")).alias("at"), F.min(F.struct("blank", "ord", "of")).alias("first"), F.min(counts).alias("low"), F.max(counts).alias("high"), F.bool_and(F.col("blank") | (F.col("of.status") == "out_of_scope")).alias("out")
    )
    place = F.row_number().over(Window.partitionBy("role_id").orderBy(F.col("e").isNull(), "at"))
    roles = cited.withColumn("k", place).groupBy("role_id").agg(
        F.min("first").alias("first"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_and("out").alias("out"),
        F.collect_list(F.when(F.col("e").isNotNull() & (F.col("k") <= R.EVIDENCE), F.struct("k", "e"))).alias("cited"),
    )
    agree = F.col("out") | F.col("low").eqNullSafe(F.col("high"))
    pick = lambda c, other: F.when(agree, F.col(f"first.of.{c}")).otherwise(other).alias(c)
    none = F.lit(None).cast("string")
    return roles.select("role_id", pick("status", F.lit("ambiguous")), pick("reason", F.lit("alias_conflict")), pick("discipline", none), pick("type", none), F.transform(F.array_sort("cited"), lambda x: x["e"]).alias("evidence"))


def scope_inputs(roles: DataFrame, aliases: DataFrame, observations: DataFrame) -> DataFrame:
    """(role_id, ord, title, categories, employment_types): what the decision may read.

    ``roles``: role_id, canonical_title; ``aliases``: role_id, alias_id, title, first_seen; ``observations``: role_id,
    observation_id, title, category, employment_type. Titles are the aliases as seen, earliest first, or the canonical title of a
    role without one. A title keeps its first ``CATEGORIES`` distinct filings and ``EMPLOYMENTS`` employment types."""
    seen = aliases.where(F.trim("title") != "").groupBy("role_id", "title").agg(F.min(F.struct("first_seen", "alias_id")).alias("at"))
    seen = seen.select("role_id", "title", F.row_number().over(Window.partitionBy("role_id").orderBy("at")).alias("ord"))
    own = roles.join(seen, "role_id", "left").select("role_id", F.coalesce("ord", F.lit(1)).alias("ord"), F.coalesce("title", "canonical_title").alias("title"))
    said = F.exists(F.array(*[F.coalesce(F.col("category")[f], F.lit("")) for f in (*FIELDS, "experience_level")]), lambda v: v != "")
    best = lambda by: F.row_number().over(Window.partitionBy("role_id", "title").orderBy(by))
    filed = observations.where(F.col("category").isNotNull() & said).groupBy("role_id", "title", "category").agg(F.min("observation_id").alias("at"))
    filed = filed.withColumn("k", best("at")).where(F.col("k") <= R.CATEGORIES).groupBy("role_id", "title").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "category"))), lambda x: x["category"]).alias("categories"))
    worked = observations.where(F.coalesce("employment_type", F.lit("")) != "").select("role_id", "title", "employment_type").distinct()
    worked = worked.withColumn("k", best("employment_type")).where(F.col("k") <= R.EMPLOYMENTS).groupBy("role_id", "title").agg(F.array_sort(F.collect_list("employment_type")).alias("employment_types"))
    joined = own.join(filed, ["role_id", "title"], "left").join(worked, ["role_id", "title"], "left")
    return joined.select("role_id", "ord", "title", F.coalesce("categories", F.array().cast(f"array<{CATEGORY}>")).alias("categories"), F.coalesce("employment_types", F.array().cast("array<string>")).alias("employment_types"))


def _quoted(c: Column) -> Column:
    """A JSON string of a text."""
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), c, F.lit('"'))


def fingerprints(titles: DataFrame) -> DataFrame:
    """(role_id, fingerprint): a hash of all that the decision reads, whatever the order of titles."""
    category = lambda c: F.concat(F.lit("{"), F.concat_ws(", ", *[F.when(c[f].isNotNull(), F.concat(F.lit(f'"{f}": '), _quoted(c[f]))) for f in ("department", "experience_level", "function", "team")]), F.lit("}"))
    listed = lambda a: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(a), _quoted), ","), F.lit("]"))
    item = F.concat(F.lit("["), _quoted(F.col("title")), F.lit(","), listed(F.transform("categories", category)), F.lit(","), listed(F.col("employment_types")), F.lit("]"))
    rows = titles.select("role_id", F.col("title").alias("t"), item.alias("item"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("t", "item"))), lambda x: x["item"])
    return rows.groupBy("role_id").agg(F.sha2(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")), 256).alias("fingerprint"))


def reviewed(decided: DataFrame, stored: DataFrame, reviews: DataFrame, prints: DataFrame) -> DataFrame:
    """What a pass stores: a person's decision while its evidence is unchanged, else the rules' decision.

    ``stored``: role_id, status, reason, discipline, type, method. ``reviews``: role_id, decided_at, fingerprint; the
    latest counts. ``outcome`` is human_reviewed, unchanged or written."""
    latest = reviews.groupBy("role_id").agg(F.max_by("fingerprint", "decided_at").alias("seen"))
    told = ("status", "reason", "discipline", "type")
    old = stored.select("role_id", F.struct(*told, "method").alias("old"))
    rows = decided.join(old, "role_id", "left").join(latest, "role_id", "left").join(prints, "role_id")
    kept = F.coalesce((F.col("old.method") == "human_review") & (F.col("seen") == F.col("fingerprint")), F.lit(False))
    now = F.struct(*told, F.lit("deterministic").alias("method"))
    same = F.col("old").eqNullSafe(now)
    outcome = F.when(kept, "human_reviewed").when(same, "unchanged").otherwise("written")
    return rows.select("role_id", *[F.when(kept, F.col(f"old.{c}")).otherwise(F.col(c)).alias(c) for c in told], F.when(kept, F.lit("human_review")).otherwise("deterministic").alias("method"), outcome.alias("outcome"))


def summary(passed: DataFrame) -> DataFrame:
    """Roles of a pass by status, reason, discipline, type and outcome."""
    return passed.groupBy("status", "reason", F.coalesce("discipline", F.lit("")).alias("discipline"), F.coalesce("type", F.lit("")).alias("type"), "outcome").agg(F.count(F.lit(1)).alias("roles"))
