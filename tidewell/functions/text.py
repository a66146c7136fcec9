"""Title, company, address and redaction functions on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word lists of the title and company rules.
LEGAL_FORMS = ("inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "company", "co")
TITLE_STOPS = (
    "a", "about", "an", "and", "any", "anyone", "anything", "application", "applications", "apply", "are", "as", "at", "be", "been", "best", "bet", "but", "by", "can", "career", "careers", "chance", "chances", "co", "companies",
    "company", "competitive", "coop", "coops", "could", "current", "currently", "deadline", "deadlines", "deal", "did", "do", "does", "early", "expect", "expected", "eye", "for", "forecast", "from", "get", "give", "going", "good",
    "grad", "grads", "graduate", "graduates", "had", "has", "have", "hear", "heard", "hire", "hiring", "historical", "history", "how", "i", "if", "in", "intern", "interns", "internship", "internships", "into", "is", "it", "its",
    "job", "jobs", "keep", "know", "last", "lately", "like", "likely", "look", "looking", "many", "me", "month", "more", "movement", "much", "my", "need", "new", "news", "next", "now", "odds", "of", "on", "op", "open", "opened",
    "opening", "openings", "opens", "ops", "or", "our", "out", "people", "plan", "position", "positions", "posted", "posting", "postings", "predict", "prediction", "prepare", "preparing", "program", "programs", "reach", "ready",
    "recruiting", "role", "roles", "rundown", "s", "season", "should", "show", "so", "someone", "soon", "start", "starts", "team", "teams", "tell", "than", "that", "the", "their", "them", "then", "there", "these", "they", "think",
    "thinking", "this", "those", "time", "timing", "to", "too", "track", "tracking", "typical", "typically", "unspecified", "update", "updates", "us", "usually", "was", "we", "were", "what", "whats", "when", "where", "which", "who",
    "why", "will", "window", "with", "worth", "worthwhile", "would", "year", "years", "you", "your",
)
INFLECTIONS = {
    "analysts": "analyst", "designers": "designer", "developers": "developer", "engineering": "engineer", "engineers": "engineer", "managers": "manager", "representatives": "representative", "researchers": "researcher", "scientists": "scientist",
}
#: What each step of normalising a title replaces, and by what.
TITLE_STEPS = (
    (r"^\s*apply\s+(?:for|to|now\s+for)\s+", " "), (r"\b(?:19|20)\d{2}\b", " "), (r"\b(?:university|campus|early career|students?)\b", " "), (r"\bswe\b", "software engineer"),
    (r"\bsoftware engineering internships?\b", "software engineer intern"), (r"\bsoftware engineer internships?\b", "software engineer intern"), (r"\binternships?\b", "intern"), (r"\bnew[- ]grad(?:uate)?\b", "new grad"), (r"[^a-z0-9+]+", " "),
)
#: Levels, families, specializations and tracks by the first rule that applies.
LEVELS = (
    ("internship", r"\b(intern|internship|co-op|coop)\b"), ("apprenticeship", r"\b(apprentice|apprenticeship)\b"), ("new_grad", r"\b(new grad|new graduate|graduate program|entry[- ]level|university graduate)\b"),
    ("full_time", r"\b(senior|staff|principal|manager|director|lead)\b"),
)
FAMILIES = (
    ("machine_learning", ("machine learning", "ml engineer", "artificial intelligence")), ("data_science", ("data scientist", "data science")), ("data_engineering", ("data engineer",)),
    ("software_engineering", ("software engineer", "software developer", "full stack", "frontend", "backend")), ("hardware_engineering", ("hardware engineer", "electrical engineer", "silicon")),
    ("mechanical_engineering", ("mechanical engineer", "robotics engineer")), ("product_management", ("product manager", "apm")), ("product_design", ("product designer", "ux designer", "user experience")),
    ("finance", ("financial analyst", "finance")), ("consulting", ("consultant", "consulting")),
)
SPECIALIZATIONS = (
    ("security", ("security", "cyber")), ("infrastructure", ("infrastructure", "distributed systems", "cloud platform")), ("frontend", ("frontend", "front end", "web ui")), ("backend", ("backend", "back end", "server-side")),
    ("mobile", ("ios", "android", "mobile")), ("machine_learning", ("machine learning", " ml ", "artificial intelligence")), ("embedded", ("embedded", "firmware")),
)
TRACKS = (
    ("apprenticeship", r"\bapprentice(?:s|ships?)?\b"), ("internship", r"\b(?:interns?|internships?|co-?ops?)\b"),
    ("new_grad", r"\b(?:new[- ]grads?|new graduates?|graduate programs?|grad programs?|entry[- ]level)\b"),
)
#: Second-level labels of public suffixes; parameters that only track.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
TRACKING = "^(utm_[a-z]+|gclid|fbclid|ref|source|gh_src)="


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def normalize_title(c: Column) -> Column:
    """Lower case, without lead-in, years and words of the cohort, with one spelling for common terms."""
    return F.trim(reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), TITLE_STEPS, F.lower(c)))


def normalize_company(c: Column) -> Column:
    return F.array_join(F.filter(_all(F.lower(c), "[a-z0-9]+"), lambda w: ~w.isin(*LEGAL_FORMS)), " ")


def slug(c: Column) -> Column:
    return F.array_join(_all(F.lower(c), "[a-z0-9]+"), "_")


def identifying_tokens(title: Column, company: Column) -> Column:
    """Words of a title that tell it from others: inflections as one, no stop words, none of the company's."""
    same = F.create_map(*[F.lit(v) for pair in INFLECTIONS.items() for v in pair])
    words = F.transform(_all(normalize_title(title), "[a-z0-9+]+"), lambda w: F.coalesce(F.element_at(same, w), w))
    told = F.filter(words, lambda w: ~w.isin(*TITLE_STOPS))
    return F.array_sort(F.array_except(told, _all(normalize_company(company), "[a-z0-9]+")))


def _first_rule(text: Column, rules: tuple, otherwise: str) -> Column:
    return F.coalesce(*[F.when(text.rlike(rx), name) for name, rx in rules], F.lit(otherwise))


def level(c: Column, employment: Column | None = None, description: Column | None = None) -> Column:
    """What a title, its employment type and the start of its description say of the level."""
    text = F.lower(F.concat_ws(" ", c, *[v for v in (employment, None if description is None else F.left(description, F.lit(2000))) if v is not None]))
    stated = _first_rule(text, LEVELS, "unknown")
    return stated if employment is None else F.when((stated == "unknown") & F.lower(F.coalesce(employment, F.lit(""))).contains("full"), "full_time").otherwise(stated)


def title_level(c: Column) -> Column:
    """The level that a title states by itself; a bare "graduate" counts where nothing else does."""
    stated = level(c)
    return F.when((stated == "unknown") & F.lower(c).rlike(r"\bgraduates?\b"), "new_grad").otherwise(stated)


def tracks(c: Column) -> Column:
    """Early-career tracks that a question names, sorted."""
    return F.filter(F.array(*[F.when(F.lower(c).rlike(rx), name) for name, rx in TRACKS]), lambda x: x.isNotNull())


def stated_types(c: Column) -> Column:
    """The early-career types that a title states, sorted."""
    t = F.lower(c)
    rules = (("apprenticeship", r"\bapprentice(ship)?s?\b"), ("internship", r"\b(intern|interns|internship|internships|co-?op)\b"), ("new_grad", r"\b(new[-\s]grad(uate)?|university grad(uate)?|early career)\b"))
    return F.filter(F.array(*[F.when(t.rlike(rx), name) for name, rx in rules]), lambda x: x.isNotNull())


def _first_marker(text: Column, rules: tuple, otherwise: str | None) -> Column:
    has = lambda markers: reduce(lambda x, y: x | y, [text.contains(m) for m in markers])
    return F.coalesce(*[F.when(has(markers), name) for name, markers in rules], F.lit(otherwise))


def family(c: Column) -> Column:
    return _first_marker(normalize_title(c), FAMILIES, "other")


def specialization(c: Column, description: Column | None = None) -> Column:
    """The first specialization that a title or the start of its description names, or null."""
    about = F.lit("") if description is None else F.lower(F.left(F.coalesce(description, F.lit("")), F.lit(1000)))
    return _first_marker(F.concat(F.lit(" "), normalize_title(c), F.lit(" "), about, F.lit(" ")), SPECIALIZATIONS, None)


def recruiting_season(c: Column, description: Column | None = None) -> Column:
    """The first of spring, summer, fall and winter that a text names, or that it hires all year."""
    text = F.lower(c if description is None else F.concat_ws(" ", c, F.left(description, F.lit(2000))))
    return _first_rule(text, tuple((s, rf"\b{s}\b") for s in ("spring", "summer", "fall", "winter")) + (("year_round", r"\b(year[- ]round|rolling)\b"),), "unknown")


def season(c: Column) -> Column:
    """The first season that a text names as a whole word."""
    word = F.regexp_extract(F.lower(c), r"\b(spring|summer|fall|autumn|winter)\b", 1)
    return F.when(word == "", "unknown").when(word == "autumn", "fall").otherwise(word)


def cycle_key(title: Column, role_season: Column) -> Column:
    """season-year of a title that states a year, with the role's season where the title has none."""
    year = F.regexp_extract(title, r"\b(20[2-9][0-9])\b", 1)
    own = season(title)
    return F.when(year != "", F.concat_ws("-", F.when(own != "unknown", own).otherwise(F.when(role_season == "unknown", "unspecified").otherwise(role_season)), year))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays; one half where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.5).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def strip_html(c: Column, limit: int = 4000) -> Column:
    """Tags to blanks, the five common references decoded, white space folded, cut at ``limit``."""
    text = F.regexp_replace(c, "(?s)<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.left(F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " ")), F.lit(limit))


def identity_url(c: Column) -> Column:
    """One spelling of an address: lower-case host, no fragment, tracking parameters out, the rest sorted."""
    bare = F.regexp_replace(c, "#.*$", "")
    base, rest = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"\?(.*)$", 1)
    host = F.lower(F.regexp_extract(base, r"^([a-zA-Z]+://[^/]*)", 1))
    path = F.regexp_replace(F.regexp_replace(base, r"^[a-zA-Z]+://[^/]*", ""), r"/+$", "")
    kept = F.array_sort(F.filter(F.split(rest, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def registrable_label(c: Column) -> Column:
    """The label under which an address's host is registered."""
    return domain_label(F.regexp_extract(c, r"^[a-zA-Z]+://([^/:?#]+)", 1))


def domain_label(domain: Column) -> Column:
    """The label that a domain is registered under: x of x.co.uk, of x.com and of www.x.com."""
    labels = F.filter(F.split(F.lower(domain), r"\."), lambda w: w != "")
    second = (F.size(labels) >= 3) & F.coalesce(F.try_element_at(labels, F.lit(-2)), F.lit("")).isin(*SECOND_LEVEL)
    return F.coalesce(F.when(second, F.try_element_at(labels, F.lit(-3))), F.try_element_at(labels, F.lit(-2)), F.try_element_at(labels, F.lit(-1)), F.lit(""))


def bounded_utf8(c: Column, n: int) -> Column:
    """At most ``n`` bytes without control characters, never half a character."""
    clean = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.when(F.octet_length(clean) <= n, clean).otherwise(F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(clean, "UTF-8"), 1, n).cast("string")), "�+$", ""))


def redact(c: Column) -> Column:
    """Tokens, secrets in parameters, credentials in addresses, e-mail addresses, telephone numbers."""
    steps = (
        (r"(?i)bearer\s+[A-Za-z0-9._-]+", "Bearer [redacted]"), (r"(?i)\b(token|secret|password|api_key)(\s*=\s*)\"?[A-Za-z0-9_-]+\"?", "$1$2[redacted]"), (r"://[^/@\s:]+:[^/@\s]+@", "://[redacted]@"),
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]"), (r"\+?[0-9][0-9 ()-]{7,}[0-9]", "[phone]"),
    )
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c)


def quote(text: Column, hit: Column, size: int = 1000, before: int = 160) -> Column:
    """A window of a text that starts a little before a word; null where it does not occur."""
    at = F.instr(text, hit)
    return F.when(at > 0, F.substring(text, F.greatest(F.lit(1), at - before), F.lit(size)))


def confidence_phrase(c: Column) -> Column:
    return F.when(c.isNull(), "no forecast").otherwise(F.concat(F.when(c >= 75, "strong").when(c >= 60, "moderate").otherwise("limited"), F.lit(" confidence ("), F.round(c).cast("int").cast("string"), F.lit("%)")))


def display_title(c: Column) -> Column:
    """Capitalised words, acronyms upper case, never empty."""
    words = F.transform(F.split(F.trim(c), r"\s+"), lambda w: F.when(F.lower(w).isin("swe", "ml", "ai", "qa", "ui", "ux", "it"), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))))
    return F.coalesce(F.nullif(F.array_join(words, " "), F.lit("")), F.lit("Untitled role"))


def padded_words(c: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(_all(F.lower(c), "[a-z0-9]+"), " "), F.lit(" "))


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Version-5 UUID of a name in a namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))
