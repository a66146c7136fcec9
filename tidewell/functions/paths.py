"""Which addresses may be collected: recruiting pages, postings, sitemaps, and sections that hold none.

Every rule is a column expression over an address; words are runs of letters a-z and digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and stems of hosts and paths that name recruiting, and phrases of them.
RECRUITING = (
    "apprentice|apprentices|apprenticeship|apprenticeships|campus|career|careers|carreira|carreiras|carriere|carrieres|empleo|empleos|emploi|emplois|"
    "grad|graduate|graduates|grads|hiring|intern|interns|internship|internships|job|jobs|karriere|opening|openings|position|positions|recruit|recruiting|"
    "recruitment|stellen|stellenangebote|student|students|talent|universities|university|vacancies|vacancy|"
    "early career|early careers|join us|join our team|work with us|work at|workwithus|joinus|earlycareers|(?:career|job|karriere|recruit)[a-z0-9]*"
)
#: First words of a section without postings.
SECTION = (
    "article|articles|benefits|blog|blogs|contact|cookie|cookies|customers|developers|doc|docs|documentation|event|events|faq|faqs|help|insights|investor|"
    "investors|knowledge|legal|news|newsroom|partner|partners|podcast|podcasts|post|posts|press|pricing|privacy|stories|story|terms|webinar|webinars|"
    "author|authors|categories|category|tag|tags"
)
#: Words of a segment below which postings lie, in a sitemap and elsewhere; words of a role.
POSTING = "career|careers|opening|openings|position|positions|requisition|requisitions|vacancy|vacancies|job[a-z0-9]*"
PARENT = "job|jobs|position|positions|opening|openings|vacancy|vacancies"
ROLE = (
    "analyst|apprentice|apprenticeship|architect|associate|designer|developer|engineer|engineering|graduate|intern|interns|internship|internships|manager|"
    "research|researcher|scientist|specialist|technician|trader"
)
#: Words of a sitemap's name that say nothing; dated posts and archives; ids of single postings.
GENERIC = "sitemap|sitemaps|sitemapindex|index|tree|root|main|wp|pages|xml|[0-9]+"
ARCHIVE = r"^/(?:(?:19|20)[0-9]{2}/[0-9]{2}/|(?:tag|category|author)/|wp-json/)"
ROOT_SITEMAP = r"^(?:/sitemaps?)?/[a-z0-9_-]+\.xml$"
POSTING_ID = "^(?:(?:[a-z0-9-]*-)?[0-9]{6,}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$"
HOST = "^[^:/?#]+://(?:[^/?#@]*@)?([^/:?#]*)"
PATH = "^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)"


def path(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PATH, 1))


def padded(text: Column) -> Column:
    """The words of a text with one space before and after each, so whole words and phrases match by pattern."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), F.lit(" "))


def has(text: Column, words: str) -> Column:
    return padded(text).rlike(f" (?:{words}) ")


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def _above(url: Column) -> Column:
    """All segments but the last."""
    s = segments(url)
    return F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))


def not_a_posting_page(url: Column) -> Column:
    """Below a section without postings, unless the segment before names postings; or a dated or archive path."""
    s = segments(url)
    starts = F.transform(s, lambda x, i: F.regexp_extract(x, "[a-z0-9]+", 0).rlike(f"^(?:{SECTION})$") & ~F.coalesce(has(F.get(s, i - 1), PARENT), F.lit(False)))
    return path(url).rlike(ARCHIVE) | F.exists(starts, lambda x: x)


def single_job_page(url: Column) -> Column:
    """The last segment is a posting's id, or names a role below a segment of postings."""
    last = F.coalesce(F.try_element_at(segments(url), F.lit(-1)), F.lit(""))
    return last.rlike(POSTING_ID) | (has(last, ROLE) & F.exists(_above(url), lambda x: has(x, PARENT)))


def recruiting_host(url: Column) -> Column:
    labels = F.split(F.lower(F.regexp_extract(url, HOST, 1)), r"\.")
    return F.exists(F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0))), lambda x: has(x, RECRUITING))


def recruiting_page(url: Column) -> Column:
    return ~not_a_posting_page(url) & (recruiting_host(url) | has(path(url), RECRUITING))


def sitemap_job_page(url: Column) -> Column:
    """A sitemap's page below a segment of postings."""
    return ~not_a_posting_page(url) & F.exists(_above(url), lambda x: has(x, POSTING))


def recruiting_sitemap(url: Column) -> Column:
    """Named for recruiting, or a root sitemap whose name says nothing else."""
    p = path(url)
    generic = p.rlike(ROOT_SITEMAP) & padded(p).rlike(f"^ *(?:(?:{GENERIC}) +)*$")
    return ~not_a_posting_page(url) & (has(p, RECRUITING) | generic)


def refusal(adapter: Column, url: Column) -> Column:
    """The rule that refuses a source, null where none does; other adapters are always allowed."""
    pages = F.when(not_a_posting_page(url), "in_a_non_recruiting_section").when(single_job_page(url), "a_single_job_posting").when(~recruiting_page(url), "off_the_recruiting_path")
    return F.when(adapter == "sitemap", F.when(~recruiting_sitemap(url), "not_a_recruiting_sitemap")).when(adapter.isin("generic", "wayback"), pages)
