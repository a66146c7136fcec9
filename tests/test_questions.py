"""Questions, ladder routes and latest outcomes, hand-worked."""

import json

from tidewell.operators import questions as Q
from tidewell.operators import records as R
from tidewell.sources import ladder as L

COMPANIES = [(1, "Spotify", "open.spotify.com"), (2, "GitLab", "about.gitlab.com"), (3, "Belvedere Trading", "belvederetrading.com"), (4, "IBM", "ibm.com"), (5, "Hudson River Trading", "hudsonrivertrading.com"), (6, "Gone", "gone.com")]


def test_companies(spark):
    asked = {1: "When does a program open about anything?", 2: "When do trading firms open?", 3: "ibm interns", 4: "spotify or gitlab internships", 5: "Is gone.com hiring", 6: "", 7: "Hudson and Belvedere Trading"}
    got = Q.companies(spark.createDataFrame(list(asked.items()), "question_id int, text string"), spark.createDataFrame(COMPANIES, "company_id int, name string, domain string"), spark.createDataFrame([(6,)], "company_id int"))
    found = {}
    for r in got.collect():
        found.setdefault(r["question_id"], set()).add((r["company_id"], r["score"]))
    # Generic words and first labels name no firm; a name in full counts three; ties stay; a withdrawn company is none.
    assert found == {3: {(4, 3)}, 4: {(1, 4), (2, 4)}, 7: {(3, 4)}}


def test_roles(spark):
    rows = [(1, 1, "acme", "internship", None, None, True), (2, 1, "acme", "internship", "london", None, True), (3, 1, "acme", "new_grad", None, None, True), (4, 1, "acme", "internship", None, None, False), (5, 2, "beta", "new_grad", None, None, True)]
    names = [(1, "Software Engineer Intern"), (2, "Software Engineer Intern"), (3, "Software Engineer New Grad"), (4, "Quantitative Trader Intern"), (5, "Program")]
    asked = {1: "Acme software engineering internships", 2: "acme software engineers in London intern", 3: "acme quantitative traders intern", 4: "acme intern?", 5: "acme basket weaving intern", 6: "when does beta open", 7: "acme roles"}
    found = spark.createDataFrame([(q, 2 if q == 6 else 1) for q in asked], "question_id int, company_id int")
    got = Q.roles(found, spark.createDataFrame(list(asked.items()), "question_id int, text string"), spark.createDataFrame(rows, "role_id int, company_id int, company string, track string, location_scope string, specialization string, in_scope boolean"), spark.createDataFrame(names, "role_id int, name string"))
    told = {}
    for r in got.collect():
        told.setdefault(r["question_id"], set()).add(r["role_id"])
    # Track is a hard filter; words decide, ties stay; out of scope only where nothing in scope is meant; no words fall back to the track or the only role.
    # Question 3's words meet no role in scope, so all roles are looked at.
    assert told == {1: {1, 2}, 2: {2}, 3: {4}, 4: {1, 2}, 6: {5}}


def test_equal_questions_and_roles_are_matched_once(spark, monkeypatch):
    written = {}

    def counted(df, label, write=Q.materialize):
        out = write(df, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(Q, "materialize", counted)
    rows = [(r, 1 + r % 2, "acme" if r % 2 == 0 else "beta", "internship", None, None, r < 30) for r in range(40)]
    names = [(r, "Software Engineer Intern") for r in range(40)] + [(3, "Trader Intern")]
    asked = [(q, ("Acme software engineers", "ACME software engineer!", "beta trader", "acme internship", None)[q % 5]) for q in range(100)]
    found = spark.createDataFrame([(q, 2 if q % 5 == 2 else 1) for q, _ in asked], "question_id int, company_id int")
    got = Q.roles(found, spark.createDataFrame(asked, "question_id int, text string"), spark.createDataFrame(rows, "role_id int, company_id int, company string, track string, location_scope string, specialization string, in_scope boolean"), spark.createDataFrame(names, "role_id int, name string"))
    told = {}
    for r in got.collect():
        told.setdefault(r["question_id"], []).append(r["role_id"])
    even = list(range(0, 30, 2))
    assert {q: sorted(x) for q, x in told.items()} == {q: even if q % 5 in (0, 1, 3) else [3] for q, _ in asked if q % 5 != 4}
    # Two texts ask acme the same; 40 roles are called in two ways and are in scope or not.
    assert written == {"asked": 4, "asks": 3, "kinds": 5, "meant": 3}


def test_ladder(spark):
    page = lambda *scripts: "".join(f'<script type="{t}">{json.dumps(v) if not isinstance(v, str) else v}</script>' for t, v in scripts)
    job = {"@type": "JobPosting", "title": "J", "url": "/j", "jobLocation": [{"address": {"city": "A", "country": "B"}}, "C"]}
    pages = {
        1: page(("application/ld+json", [[{"@graph": [job]}]]), ("application/json", {"title": "E", "url": "/e"})), 2: page(("application/json", {"a": {"b": [{"jobTitle": "E", "jobUrl": "/e", "location": {"name": "N", "city": "x"}}]}})),
        3: page(("application/ld+json", "{nope"), ("application/ld+json", {"@type": "Thing", "title": "T", "url": "/t"})) + '<a href="/jobs/1">Analyst</a>', 4: "", 5: page(("application/ld+json; charset=utf-8", {"title": "S", "url": "/s"})), 6: page(("application/ld+json", {"@type": ["JobPosting"], "title": "no address"})),
    }
    df = spark.createDataFrame([(k, "https://x.com/c/", "Own", h) for k, h in pages.items()], "page_id int, url string, company string, html string")
    got = {r["page_id"]: tuple(r)[1:] for r in L.extract(df).collect()}
    assert got == {
        1: ("json_ld", "J", "https://x.com/j", "https://x.com/j", "Own", "A, B · C", None), 2: ("embedded_data", "E", "https://x.com/e", "https://x.com/e", "Own", "N", None), 3: ("static_html", "Analyst", "https://x.com/jobs/1", "https://x.com/jobs/1", "Own", None, None),
        4: ("none", None, None, None, None, None, None), 5: ("embedded_data", "S", "https://x.com/s", "https://x.com/s", "Own", None, None), 6: ("none", None, None, None, None, None, None),
    }
    assert [tuple(r) for r in L.diagnostics(df).collect()] == [(3, "application/ld+json", "malformed_json")]
    assert L.extract(df.limit(0)).count() == 0


def test_latest_outcomes(spark):
    note = lambda *items: json.dumps({"skipped_targets": [dict(zip(("target_event_id", "role_id", "target_year", "reason"), i, strict=True)) for i in items]})
    runs = spark.createDataFrame([(1, 5, 1, note((9, 9, 2000, "old"))), (2, 6, 1, note((1, 1, 2001, "scored too"), (2, 1, 2002, "b"))), (2, 6, 1, note((2, 1, 2002, "a"), (3, 2, 2002, "c"))), (3, 6, 0, note((8, 8, 2000, "x")))], "run_id int, finished_at int, created_at int, metrics string")
    cases = spark.createDataFrame([(2, 1, 1, 2001), (2, 1, 1, 2001), (1, 7, 7, 2001)], "run_id int, event_id bigint, role_id bigint, year int")
    got = sorted(map(tuple, R.latest_outcomes(runs, cases).collect()))
    assert got == [(1, 1, 2001, "scored", None), (2, 1, 2002, "skipped", "a"), (3, 2, 2002, "skipped", "c")]
    assert [r["event_id"] for r in R.page_of(R.latest_outcomes(runs, cases), 500, 1, "event_id").collect()] == [2, 3]
