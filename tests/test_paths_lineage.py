"""Address rules and lineage rules against values worked out by hand."""

from pyspark.sql import functions as F

from tidewell.functions import paths as P
from tidewell.operators import lineage as L


def test_refusals(spark):
    cases = {
        ("generic", "https://www.x.com/careers"): None,
        ("generic", "https://www.x.com/internet"): "off_the_recruiting_path",
        ("generic", "https://careers.x.com/"): None,
        ("generic", "https://x.com/join-us/stories/an-internship"): "in_a_non_recruiting_section",
        ("generic", "https://x.com/careers/4981249"): "a_single_job_posting",
        ("wayback", "https://x.com/hrt-job/hardware-engineer-internship-summer-2027"): "a_single_job_posting",
        ("wayback", "https://x.com/join-us/jobs/technology"): None,
        ("generic", "https://x.com/careers/emerging-talent-2026"): None,
        ("sitemap", "https://x.com/sitemap_index.xml"): None,
        ("sitemap", "https://x.com/sitemap-careers.xml"): None,
        ("sitemap", "https://x.com/sitemap-derivatives-index.xml"): "not_a_recruiting_sitemap",
        ("greenhouse", "https://x.com/blog"): None,
        ("generic", None): None,
        ("generic", ""): "off_the_recruiting_path",
    }
    rows = spark.createDataFrame([(a, u, want) for (a, u), want in cases.items()], "adapter string, url string, want string")
    got = rows.where("url is not null").withColumn("got", P.refusal(F.col("adapter"), F.col("url"))).collect()
    assert [(r.url, r.got) for r in got] == [(r.url, r.want) for r in got]


def test_posting_below_a_posting_segment_is_no_section(spark):
    rows = spark.createDataFrame([("https://x.com/jobs/legal-intern", False), ("https://x.com/legal/jobs", True), ("https://x.com/2024/05/hiring", True), ("https://x.com/careers/legal", True)], "url string, want boolean")
    assert all(r.want == r.got for r in rows.withColumn("got", P.not_a_posting_page(F.col("url"))).collect())


def test_signal_goes_to_the_longest_role_and_a_tie_to_none(spark):
    roles = spark.createDataFrame([("c", "a", ["red", "ring"]), ("c", "b", ["big", "red", "ring"]), ("c", "d", ["old", "nut"]), ("c", "e", ["nut", "dry"]), ("c", "one", ["nut"])], "company string, role string, tokens array<string>")
    evidence = spark.createDataFrame([(1, "c", ["big", "red", "ring"]), (2, "c", ["red", "ring"]), (3, "c", ["old", "nut", "dry"]), (4, "c", ["nut"]), (5, "z", ["red", "ring"]), (6, "c", [])], "evidence_id int, company string, words array<string>")
    got = {r.evidence_id: r.role for r in L.resolve_signals(evidence, roles).collect()}
    assert got == {1: "b", 2: "a", 3: None, 4: None, 5: None, 6: None}


def test_insert_once(spark):
    stored = spark.createDataFrame([("i1", 1, "open")], "identity string, role int, kind string")
    new = spark.createDataFrame([(1, "i1", 9, "x"), (2, "i2", 1, "open"), (3, "i3", 2, "open"), (4, "i3", 2, "close"), (5, "i4", 2, "open")], "seq int, identity string, role int, kind string")
    assert [r.seq for r in L.insert_once(new, stored, "identity", ["role", "kind"], "seq").collect()] == [3]


def test_changes_effects_and_lines(spark):
    v = spark.sql("select * from values (1, 7, date'2024-01-01', date'2024-05-01', date'2024-06-01', 'low'), (2, 7, date'2024-02-01', date'2024-05-01', date'2024-06-01', 'low'), (3, 7, date'2024-03-01', date'2024-05-04', date'2024-06-01', 'low') t(forecast_id, role_id, forecasted_on, window_start, window_end, word)")
    assert sorted((r.after_id, r.start_delta, r.felt) for r in L.lineage(L.changes(v), v).collect()) == [(2, 0, False), (3, 3, True)]
    e = spark.sql("select * from values ('prior_support', 0.54), ('prior_support', 0.55), ('prior_support', 0.75), ('signal_conflict', 0.25), ('signal_conflict', 0.45), ('signal_conflict', 0.46) t(n, v)")
    assert [r[0] for r in e.select(L.effect(F.col("n"), F.col("v").cast("double"))).collect()] == ["limits", "neutral", "supports", "supports", "neutral", "limits"]
    t = spark.createDataFrame([("Apply\nold", "OLD\nApply now\nother\napply 2")], "a string, b string")
    assert t.select(L.added_lines(F.col("a"), F.col("b"), "apply")).first()[0] == "Apply now · apply 2"
