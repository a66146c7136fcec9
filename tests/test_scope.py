"""Scope decisions, hand-worked: titles before filings, filings with their own titles, reviews kept while the evidence is the same."""

import hashlib

import pytest

from tidewell.operators import scope as O

TITLES = f"role_id int, ord int, title string, categories array<{O.CATEGORY}>, employment_types array<string>"


def category(department=None, team=None, function=None, level=None):
    return (department, team, function, level)


CASES = {
    1: ([("Software Engineer Intern", [category("Sales")], [])], ("in_scope", "in_scope", "software_engineering", "internship")),
    2: ([("Software Engineer Intern, Robotics", [], ["Intern"]), ("Software Engineer, Robotics", [], ["Full-time"])], ("ambiguous", "alias_conflict", None, None)),
    3: ([("Software Developer", [category(level="internship")], [])], ("in_scope", "in_scope", "software_engineering", "internship")),
    4: ([("Software Engineer Intern", [category(level="mid_senior_level")], [])], ("ambiguous", "seniority_conflict", None, "internship")),
    5: ([("Internships & Early Careers", [], [])], ("out_of_scope", "not_a_role", None, None)),
    6: ([("Internship Program Manager", [], [])], ("out_of_scope", "not_early_career", None, None)),
    7: ([("Manager I, Engineering - APM Serverless", [], [])], ("out_of_scope", "senior_role", None, None)),
    8: ([("Associate Product Manager Intern", [], [])], ("in_scope", "in_scope", "product_management", "internship")),
    9: ([("Privacy and Civil Liberties Engineer Intern", [], [])], ("ambiguous", "discipline_unknown", None, "internship")),
    10: ([("Graduate Intern, Nuclear", [], [])], ("out_of_scope", "unlisted_technical_discipline", None, "internship")),
    11: ([("Engineer", [category("Platform")], ["International"])], ("out_of_scope", "not_early_career", None, None)),
    12: ([("Intern New Grad", [], [])], ("ambiguous", "early_career_type_conflict", None, None)),
    13: ([("Intérn Développeur", [], [])], ("in_scope", "in_scope", "software_engineering", "internship")),
    14: ([("  ", [category("Data Science")], []), ("Data Science Intern", [], [])], ("in_scope", "in_scope", "data", "internship")),
    15: ([(None, [category("Data Science", level="internship")], ["Intern"])], ("out_of_scope", "not_early_career", None, None)),
    16: ([("Barista", [], []), ("Director of Sales", [], [])], ("out_of_scope", "not_early_career", None, None)),
    17: ([("Embedded Software Engineer, Machine Learning Intern", [], [])], ("in_scope", "in_scope", "hardware", "internship")),
    18: ([("Summer Analyst", [category("University Programs", "Backend")], [])], ("in_scope", "in_scope", "software_engineering", "new_grad")),
    19: ([("Analyst", [category("Interns", level="internship")], [])], ("ambiguous", "discipline_unknown", None, "internship")),
    20: ([("Product Manager, Marketing Intern", [], [])], ("ambiguous", "function_and_discipline_conflict", None, "internship")),
    21: ([("Engineering Intern", None, None)], ("ambiguous", "discipline_unknown", None, "internship")),
}


@pytest.fixture(scope="module")
def titles(spark):
    return spark.createDataFrame([(r, i, t, c, w) for r, (rows, _) in CASES.items() for i, (t, c, w) in enumerate(rows)], TITLES)


def test_decisions_and_evidence(spark, titles):
    got = {r["role_id"]: r for r in O.classify(titles).collect()}
    assert {k: tuple(r[c] for c in ("status", "reason", "discipline", "type")) for k, r in got.items()} == {k: want for k, (_, want) in CASES.items()}
    for r in got.values():
        assert r["status"] != "in_scope" or (r["evidence"][0]["kind"] == "early_career" and any(e["kind"] == "discipline" for e in r["evidence"]))
        assert r["evidence"] or r["reason"] == "not_early_career"
    assert all(e["tier"] == "title" for e in got[1]["evidence"])
    assert [(e["rule"], e["field"]) for e in got[19]["evidence"]] == [("internship", "experience_level")]  # the level takes the department's place
    assert len(got[2]["evidence"]) == len({tuple(e) for e in got[2]["evidence"]})


def test_a_review_holds_while_its_evidence_does(spark, titles):
    prints = O.fingerprints(titles)
    known = {r["role_id"]: r["fingerprint"] for r in prints.collect()}
    text = '[["Software Engineer Intern, Robotics",[],["Intern"]],["Software Engineer, Robotics",[],["Full-time"]]]'
    assert known[2] == hashlib.sha256(text.encode()).hexdigest()
    swapped = titles.where("role_id = 2").withColumn("ord", -titles["ord"])
    assert O.fingerprints(swapped).first()["fingerprint"] == known[2]
    stored = spark.createDataFrame([(1, "in_scope", "in_scope", "software_engineering", "internship", "deterministic"), (2, "in_scope", "in_scope", "robotics", "internship", "human_review"), (9, "in_scope", "in_scope", "design", "internship", "human_review")], "role_id int, status string, reason string, discipline string, type string, method string")
    reviews = spark.createDataFrame([(2, 1, "older"), (2, 2, known[2]), (9, 1, known[9]), (9, 2, "newer")], "role_id int, decided_at int, fingerprint string")
    got = {r["role_id"]: r for r in O.reviewed(O.classify(titles), stored, reviews, prints).collect()}
    assert len(got) == len(CASES)
    assert (got[1]["outcome"], got[2]["outcome"], got[9]["outcome"], got[3]["outcome"]) == ("unchanged", "human_reviewed", "written", "written")
    assert got[2]["discipline"] == "robotics" and (got[9]["status"], got[9]["method"]) == ("ambiguous", "deterministic")


def test_inputs(spark):
    roles = spark.createDataFrame([(1, "canonical"), (2, "only canonical")], "role_id int, canonical_title string")
    aliases = spark.createDataFrame([(1, 5, "B", 2), (1, 6, "A", 3), (1, 7, "A", 1), (1, 8, " ", 0), (2, 9, "", 0)], "role_id int, alias_id int, title string, first_seen int")
    seen = [(1, n, "A", category(f"d{n % 23}"), "x") for n in range(30)] + [(1, 40, "A", category(), None), (1, 41, "B", None, ""), (1, 42, "A", None, "w"), (2, 43, "other", category("d"), "x")]
    observations = spark.createDataFrame(seen, f"role_id int, observation_id int, title string, category {O.CATEGORY}, employment_type string")
    got = O.scope_inputs(roles, aliases, observations).orderBy("role_id", "ord").collect()
    assert [(r["role_id"], r["ord"], r["title"]) for r in got] == [(1, 1, "A"), (1, 2, "B"), (2, 1, "only canonical")]
    assert [c["department"] for c in got[0]["categories"]] == [f"d{n}" for n in range(20)] and got[0]["employment_types"] == ["w", "x"]
    assert got[1]["categories"] == [] and got[2]["categories"] == [] and got[2]["employment_types"] == []
