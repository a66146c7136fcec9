"""Rules on stored records against values worked out by hand."""

import datetime as dt
import hashlib
import uuid

from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import records as R


def test_a_search_has_no_wildcards(spark):
    rows = spark.createDataFrame([("Intern 50% remote",), ("Intern_2",), ("Intern 50 remote",), (None,)], "t string")
    got = [r.m for r in rows.select(R.literal_match(F.col("t"), F.lit(" 50% ")).alias("m")).collect()]
    assert got == [True, False, False, None]


def test_replay_summary(spark):
    d = dt.date(2024, 1, 1)
    rows = [(1, 1, d, "exact"), (2, 1, d + dt.timedelta(9), "bounded"), (3, 2, d, "observed_by"), (4, 2, d, "observed_by"), (5, 3, d, "exact"), (6, 4, d, "exact"), (7, 4, d, "bounded"), (8, 4, d + dt.timedelta(1), "observed_by")]
    got = R.replay_summary(spark.createDataFrame(rows, "event_id int, role int, opened_on date, precision string"), "role", "precision").first()
    assert tuple(got) == (3, 1, 2, 1, 1)
    assert tuple(R.replay_summary(spark.createDataFrame([], "event_id int, role int, opened_on date, precision string"), "role", "precision").first()) == (0, 0, 0, 0, 0)


def test_identity_splits(spark):
    rows = [(1, "a", "Research Engineer"), (1, "b", "Research Engineer"), (1, "c", "Research Intern"), (2, "d", "Intern"), (2, "e", "Co-op"), (3, "f", "Engineer"), (3, "g", "Apprentice"), (3, "h", None), (3, "i", "Apprenticeship")]
    got = {(r.role, r.stated): (r.observations, r.title, r.keeps) for r in R.identity_splits(spark.createDataFrame(rows, "role int, id string, title string"), "role", "id", "title").collect()}
    assert got == {(1, ""): (2, "Research Engineer", True), (1, "internship"): (1, "Research Intern", False), (3, ""): (2, "Engineer", False), (3, "apprenticeship"): (2, "Apprenticeship", True)}


def test_identities(spark):
    one = spark.createDataFrame([("s", "kind", "u", None, "open", " Two\n WORDS ")], "a string, b string, c string, d date, e string, f string")
    key = hashlib.sha256(b"s|kind|u||open|two words").hexdigest()
    got = one.select(R.signal_identity(*[F.col(c) for c in "abcdef"]).alias("k")).select("k", T.uuid5(R.SIGNAL_NAMESPACE, F.col("k")).alias("id")).first()
    assert (got.k, got.id) == (key, str(uuid.uuid5(uuid.UUID(R.SIGNAL_NAMESPACE), key)))


def test_meaningful_hash_ignores_order_and_repeats(spark):
    texts = spark.createDataFrame([("B\na\n\nb",), ("a\r\nB",), ("a b",), ("",), (None,)], "t string")
    got = [r.h for r in texts.select(R.meaningful_hash(F.col("t")).alias("h")).collect()]
    assert got[0] == got[1] == hashlib.sha256(b"a\nb").hexdigest() and got[2] != got[0]
    assert got[3] == got[4] == hashlib.sha256(b"").hexdigest()


def test_challenges(spark):
    pages = spark.createDataFrame([("<p>Verify  you\nare HUMAN</p> captcha challenge",), ("x" * R.CHALLENGE_CHARS + " verify you are human",), ("",), (None,)], "html string")
    assert [r.m for r in pages.select(R.challenge(F.col("html")).alias("m")).collect()] == ["verify you are human", None, None, None]


def test_published(spark):
    rows = [("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05",), ("2024-03-01T00:00:00+01:00",), ("soon Z",), (None,)]
    t = spark.createDataFrame(rows, "s string").select(R.published(F.col("s"), F.lit("2024-02-01 00:00:00").cast("timestamp")).alias("p")).select("p.*").collect()
    assert [r.rejected for r in t] == [None, "no_time_zone", "after_observation", "unreadable", None]
    assert t[0].published_at is not None and all(r.published_at is None for r in t[1:])


def test_degraded_sources_and_cursors(spark):
    day = lambda n: dt.date(2024, 1, n)
    fetches = spark.createDataFrame([("a", day(1), 1, True, False, "x"), ("a", day(2), 2, False, True, "y"), ("b", day(1), 3, False, True, "z"), ("b", day(1), 4, True, False, "w")], "s string, fetched_at date, fetch_id int, degraded boolean, complete boolean, content_hash string")
    captures = spark.createDataFrame([("a", False), ("a", True), ("b", False), ("b", True), ("c", False), (None, True)], "s string, partial boolean")
    got = sorted(((r.s or "", r.partial, r.demoted) for r in R.demoted(captures, fetches, "s", "partial").collect()))
    assert got == [("", True, False), ("a", False, False), ("a", True, False), ("b", True, False), ("b", True, True), ("c", False, False)]
    assert {r.s: (r.fetches, r.complete, r.last_content_hash) for r in R.fetch_state(fetches, "s").collect()} == {"a": (2, True, "y"), "b": (2, False, "z")}
    passes = spark.createDataFrame([("a", day(1), 0), ("a", day(2), 3), ("a", day(3), 1), ("b", day(1), 2), ("c", day(4), 0)], "s string, passed_on date, failures int")
    assert {r.s: (r.cursor_on, r.behind) for r in R.cursors(passes, "s").collect()} == {"a": (day(1), 2), "b": (None, 1), "c": (day(4), 0)}


def test_trimmable(spark):
    postings = spark.createDataFrame([(1,), (2,), (3,), (4,)], "p int")
    matches = spark.createDataFrame([(1, 7), (2, 7), (2, 8), (4, 9), (4, 9)], "p int, r int")
    roles = spark.createDataFrame([(7, "out_of_scope"), (8, "ambiguous"), (9, None)], "r int, scope string")
    assert sorted(x.p for x in R.trimmable(postings, matches, roles, "p", "r").collect()) == [1, 4]
