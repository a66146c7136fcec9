"""Rules of the operators on small tables: folds, leakage, refusal, upserts, sources, streams."""

import datetime as dt
import difflib
import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions import dates as D
from tidewell.functions import text as T
from tidewell.operators import backtest as B
from tidewell.operators import changes as K
from tidewell.operators import cycles as C
from tidewell.operators import forecast as M
from tidewell.operators import health as H
from tidewell.operators import resolution as E
from tidewell.operators import sequences as Q
from tidewell.sources import structured as U
from tidewell.streaming import windows as W

OPENING = "event_id bigint, role_id bigint, opened_on date, precision string, quality double, uncertainty double, match double, available_on date, cycle_key string"


def opening(i, role, day, precision="exact", key=None, available=None, quality=0.9):
    d = dt.date.fromisoformat(day)
    return (i, role, d, precision, quality, {"exact": 0.0, "bounded": 30.0}.get(precision), 0.9, dt.date.fromisoformat(available) if available else d, key)


def plain_cycles(events):
    """(event, cycle start) by reading one role's events in order."""
    out, anchor = {}, None
    for e in sorted(events, key=lambda e: (e[2], e[0])):
        if e[8] is not None:
            out[e[0]] = "key:" + e[8]
            continue
        if anchor is None or (e[2] - anchor).days >= C.CYCLE_DAYS:
            anchor = e[2]
        out[e[0]] = f"from:{anchor}"
    return out


def test_cycles_are_measured_from_their_first_opening(spark):
    rng = random.Random(3)
    rows = [opening(i, i % 7, str(dt.date(2015, 1, 1) + dt.timedelta(days=rng.randrange(3000))), key="annual-1" if rng.random() < 0.2 else None) for i in range(300)]
    got = {r["event_id"]: r["cycle"] for r in C.assign(spark.createDataFrame(rows, OPENING)).collect()}
    want = {}
    for role in range(7):
        want |= plain_cycles([r for r in rows if r[1] == role])
    assert got == want


def test_representative_of_a_cycle(spark):
    rows = [opening(1, 1, "2020-09-01", "observed_by"), opening(2, 1, "2020-09-01", "exact"), opening(3, 1, "2020-10-01", "exact", quality=1.0)]
    assert [r["event_id"] for r in C.collapse(C.assign(spark.createDataFrame(rows, OPENING))).collect()] == [2]


def forecast(spark, rows, signals=(), as_of=dt.date(2024, 6, 1)):
    roles = spark.createDataFrame([(r, 1 if r < 10 else 2, "software", "internship", "summer") for r in (1, 2, 3, 11)], "role_id bigint, company_id bigint, family string, level string, season string")
    s = spark.createDataFrame(list(signals), "role_id bigint, observed_on date, direction string, strength double, reliability double").withColumn("kind", F.lit("post"))
    scale = spark.createDataFrame([(1, 0.5), (2, 0.9)], "company_id bigint, scale double")
    out = M.forecast(roles, C.collapse(C.assign(spark.createDataFrame(rows, OPENING))), s, scale, as_of)
    return {r["role_id"]: r.asDict() for r in out.collect()}


HISTORY = [opening(i, 1, f"{2018 + i}-09-{10 + i}") for i in range(5)]


def test_forecast_rules(spark):
    f = forecast(spark, HISTORY)
    assert f[1]["refusal"] is None and f[1]["window_start"] <= f[1]["expected_on"] <= f[1]["window_end"] and f[1]["expected_on"].month == 9
    assert f[2]["refusal"] is None and f[2]["own_share"] == 0.0  # borrows its company's season
    assert f[11]["refusal"] is None  # borrows its family's
    assert 5 <= f[2]["confidence"] <= 48.0 < f[1]["confidence"] <= 92.0
    alone = forecast(spark, [opening(1, 1, "2022-09-01")])
    assert alone[1]["refusal"] == "sparse_history_without_prior" and alone[1]["expected_on"] is None
    assert forecast(spark, HISTORY[::-1]) == f  # order of rows does not matter


def test_signals_move_confidence_and_never_the_date(spark):
    up = [(1, dt.date(2024, 5, 20), "support", 0.9, 0.9)]
    down = [(1, dt.date(2024, 5, 20), "contradict", 0.9, 0.9)]
    a, b, c = (forecast(spark, HISTORY, s)[1] for s in ((), up, down))
    assert a["expected_on"] == b["expected_on"] == c["expected_on"] and a["half_width"] == b["half_width"]
    assert c["confidence"] < a["confidence"] < b["confidence"]


def test_late_evidence_is_not_used(spark):
    late = [*HISTORY, opening(9, 1, "2023-03-01", available="2024-07-01")]
    assert forecast(spark, late)[1] == forecast(spark, HISTORY)[1]


def test_backtest_does_not_leak(spark):
    rows = [opening(i, 1, f"{2014 + i}-09-{10 + i}") for i in range(7)]
    roles = spark.createDataFrame([(1, 1, "software", "internship", "summer"), (2, 1, "design", "internship", "summer"), (3, 2, "software", "internship", "summer")], "role_id bigint, company_id bigint, family string, level string, season string")
    signals = spark.createDataFrame([(1, dt.date(2019, 6, 1), "post", "support", 0.9, 0.9), (1, dt.date(2019, 8, 1), "post", "support", 0.9, 0.9)], "role_id bigint, observed_on date, kind string, direction string, strength double, reliability double")
    scale = spark.createDataFrame([(1, 0.5), (2, 0.9)], "company_id bigint, scale double")

    def run(r):
        c = C.assign(spark.createDataFrame(r, OPENING))
        t = B.targets(C.collapse(c), 2019, 2019)
        return {x["target_id"]: x.asDict() for x in B.cases(t, B.evidence(t, c), roles, c, signals, scale).collect()}

    base = run(rows)
    assert base[5]["skipped"] is None and base[5]["history"] == 5 and base[5]["cutoff"] < base[5]["target_on"]
    future = [*rows, opening(50, 1, "2021-02-01"), opening(51, 1, "2018-12-01", available="2020-01-01")]
    assert run(future)[5] == base[5]
    observed = [*rows[:5], opening(5, 1, "2019-09-15", "observed_by"), *rows[6:]]
    assert run(observed)[5]["skipped"] == B.OBSERVED_ONLY and run(observed)[5]["error_days"] is None
    # A role with one cycle is left out alone, and forecast from its company's or family's season as known by the cutoff.
    alone = [opening(60, 1, "2018-09-12"), opening(61, 1, "2019-09-14")]
    assert run(alone)[61]["skipped"] == B.SPARSE and run(alone[1:])[61]["skipped"] == B.NO_EVIDENCE
    for other in (2, 3):
        lent = [*alone, opening(70, other, "2017-09-20"), opening(71, other, "2018-09-25")]
        assert run(lent)[61]["skipped"] is None and run(lent[1:])[61]["history"] == 0 and run(lent[1:])[61]["skipped"] is None
        assert run([*alone, opening(70, other, "2017-09-20", available="2019-08-01")])[61]["skipped"] == B.SPARSE


def test_forecast_factors_are_worked_out_by_hand(spark):
    """Two exact openings of full quality on one day of the year, one company season."""
    import math

    rows = [opening(1, 1, "2022-09-01"), opening(2, 1, "2023-09-01"), opening(3, 2, "2021-09-01", quality=0.6)]
    f = forecast(spark, rows)
    q = rows[0][4] * rows[0][6]
    age = [(dt.date(2024, 6, 1) - dt.date(y, 9, 1)).days / 365.2425 for y in (2022, 2023)]
    own = sum(0.86**a * q for a in age)
    assert math.isclose(f[1]["f_history"], round(1 - math.exp(-own / 3), 4)) and math.isclose(f[1]["f_quality"], round(q, 4)) and f[1]["f_precision"] == 1.0
    assert f[1]["f_consistency"] > 0.998  # only the distance to the centre counts, not the openings' own spread
    # A role without openings takes quality from its seasons and precision and consistency from the forecast's spread.
    lone = f[11]
    assert lone["n"] == 0 and math.isclose(math.log(lone["f_consistency"]) * 24, math.log(lone["f_precision"]) * 30, rel_tol=2e-3) and 0 < lone["f_precision"] < 1


def test_signals_count_once(spark):
    one = [(1, dt.date(2024, 5, 20), "support", 0.9, 0.9)]
    assert forecast(spark, HISTORY, one * 3) == forecast(spark, HISTORY, one)
    kinds = "role_id bigint, observed_on date, kind string, direction string, strength double, reliability double, evidence_id string"
    row = (1, dt.date(2024, 5, 20), "post", "support", 0.9, 0.9)
    assert M.distinct_signals(spark.createDataFrame([(*row, "a"), (*row, "a"), (*row, "b"), (*row, None), (*row, None)], kinds)).count() == 3
    with pytest.raises(Exception, match="evidence id differ"):
        M.distinct_signals(spark.createDataFrame([(*row, "a"), (*row[:4], 0.5, 0.9, "a")], kinds)).collect()


def test_scale_is_the_mean_of_size_and_recruiting(spark):
    df = spark.createDataFrame([(0.35, None), (0.35, 0.75)], "a double, b double")
    assert [round(r[0], 6) for r in df.select(M.company_scale(F.col("a"), F.col("b"))).collect()] == [0.35, 0.55]


def test_circle(spark):
    days = [("2023-12-30", 1.0), ("2023-01-02", 1.0), ("2024-12-31", 1.0)]
    df = spark.createDataFrame([(dt.date.fromisoformat(a), w) for a, w in days], "d date, w double")
    c = df.agg(D.circular_center(D.cycle_day(F.col("d")), F.col("w")).alias("c")).first()["c"]
    assert c > 363 or c < 2
    opposite = spark.createDataFrame([(0.0, 1.0), (D.YEAR / 2, 1.0)], "day double, w double")
    assert opposite.agg(D.circular_center(F.col("day"), F.col("w")).alias("c")).first()["c"] is None


def test_centres_halfway_between_places_are_those_of_sql(spark, tmp_path):
    from tidewell import catalog, compare

    pairs = (("1995-01-14", "1997-10-07", "4-LOW"), ("1998-06-30", "1998-07-05", "4-LOW"), ("1995-04-14", "1995-12-02", "1-URGENT"), ("1999-12-20", "2001-01-13", "2-HIGH"))
    rows = [(2 * k + i, k, "F", dt.datetime.fromisoformat(on), priority) for k, (*days, priority) in enumerate(pairs) for i, on in enumerate(days)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    # The last pair lies just before the end of the year, by the last bit of its sums.
    assert compare.difference(spark, str(tmp_path), catalog.queries()["circular_center"], catalog.oracle_sql()["circular_center"]) == ""


def test_upsert_and_diff(spark):
    a = spark.createDataFrame([(1, "x", "t1"), (2, "y", "t1"), (3, None, "t1")], "k bigint, h string, at string")
    b = spark.createDataFrame([(2, "z", "t2"), (3, None, "t2"), (4, "w", "t2")], "k bigint, h string, at string")
    got = {r["k"]: (r["h"], r["first_seen"], r["last_seen"], r["outcome"]) for r in K.upsert(a, b, "k", "h", "at").collect()}
    assert got == {1: ("x", "t1", "t1", "kept"), 2: ("z", "t1", "t2", "changed"), 3: (None, "t1", "t2", "unchanged"), 4: ("w", "t2", "t2", "created")}
    old = spark.createDataFrame([(1, 10, "a"), (2, 10, "b"), (3, 11, "c")], "k bigint, o bigint, v string")
    new = spark.createDataFrame([(1, 10, "a"), (2, 12, "b"), (4, 11, "d")], "k bigint, o bigint, v string")
    assert {(r["k"], r["owner"], r["change"]) for r in K.diff(old, new, "k", "o", ["o", "v"]).collect()} == {(2, 10, "moved_out"), (2, 12, "moved_in"), (3, 11, "deleted"), (4, 11, "inserted")}


def test_table_hash_ignores_order(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 7)
    assert H.table_hash(df).first() == H.table_hash(df.orderBy(F.rand(1))).first()


def test_visibility(spark):
    d = lambda s: dt.date.fromisoformat(s)
    rows = [("u", d("2020-01-01"), "absent"), ("u", d("2020-01-20"), "unknown"), ("u", d("2020-01-31"), "present"), ("u", d("2020-02-10"), "present"), ("u", d("2020-03-01"), "absent"), ("u", d("2021-01-01"), "present"), ("w", d("2020-05-05"), "present")]
    got = sorted(tuple(r) for r in Q.visibility_openings(spark.createDataFrame(rows, "url string, day date, state string"), ["url"], "day", "state").collect())
    assert [(g[0], str(g[1]), g[2], str(g[5])) for g in got] == [("u", "2020-01-16", "bounded", "2020-03-01"), ("u", "2021-01-01", "observed_by", "None"), ("w", "2020-05-05", "observed_by", "None")]


def test_resolution_is_order_stable_and_separates_levels(spark):
    rows = [(1, "Acme Inc", "Software Engineer Intern Summer 2024", "build services in python", "Paris", "2024-01-01"), (2, "ACME", "Software Engineering Internship - Summer 2025", "build services in python", "Paris", "2025-01-01"), (3, "Acme", "Software Engineer New Grad", "build services in python", "Paris", "2025-01-02"), (4, "Other", "Software Engineer Intern Summer 2024", "build services in python", "Paris", "2024-01-01")]
    df = spark.createDataFrame(rows, "posting_id bigint, company string, title string, description string, location string, first_seen string")
    got = {r["posting_id"]: r["role_key"] for r in E.resolve(E.features(df)).collect()}
    assert got[1] == got[2] and len({got[1], got[3], got[4]}) == 3
    assert {r["posting_id"]: r["role_key"] for r in E.resolve(E.features(df.orderBy(F.desc("posting_id")))).collect()} == got


def test_resolution_scores_every_posting(spark):
    rnd = random.Random(3)
    titles = ["Software Engineer Intern", "Software Engineer Internship Summer", "Platform Software Intern", "Data Science Intern Fall", "Research Intern", "Quant Trading New Grad", "Technology Analyst", None]
    rows = [(i, rnd.choice(["Acme", "Bolt", None]), rnd.choice(titles), " ".join(rnd.sample("python go rust design chips risk cloud".split(), rnd.randrange(4))), rnd.choice(["Paris", "Oslo", "Remote", "United States", "Various", "", None]), f"2024-01-{i % 20 + 1:02d}") for i in range(150)]
    df = E.features(spark.createDataFrame(rows, "posting_id int, company string, title string, description string, location string, first_seen string"))
    got = {r.posting_id: (r.role_key, r.score, r.created) for r in E.resolve(df).collect()}
    assert len(got) == len(rows)
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()

    def place(a, b):
        if a == b:
            return 1.0
        if a in ("unspecified", "multi_location") or b in ("unspecified", "multi_location"):
            return 0.75
        return 0.45 if {a, b} == {"remote", "united_states"} else ratio(a, b) / 2

    roles, known, want = [], {}, {}
    for p in sorted(df.collect(), key=lambda r: (r.first_seen, r.posting_id)):
        shape = tuple(p[k] for k in E.KEYS)
        if shape in known:
            want[p.posting_id] = known[shape]
            continue
        scores = []
        for n, r in enumerate(roles):
            q = r["lead"]
            wild = (("level", "unknown", p.level, q.level), ("family", "other", p.family, q.family), ("season", "unknown", p.season, r["season"]))
            near = place(p.location, q.location)
            broad = {p.location, q.location} & set(E.BROAD)
            if (p.company, p.stated) != (q.company, q.stated) or any(a != b and w not in (a, b) for _, w, a, b in wild) or (near < 0.5 and not broad):
                continue
            x, y = set(p.about.split()), set(q.about.split())
            about = len(x & y) / len(x | y) if x and y else 0.5
            scores.append((0.3 * max(ratio(p.title, t) for t in r["titles"]) + 0.25 * about + 0.15 * near + 0.2 + 0.1 * (p.title in r["titles"]), n))
        scores.sort(key=lambda s: (-s[0], s[1]))
        best = scores[0][0] if scores else 0.0
        if scores and best >= 0.72 and (len(scores) == 1 or best - scores[1][0] >= 0.06):
            r = roles[scores[0][1]]
            r["titles"].add(p.title)
            r["season"] = p.season if r["season"] == "unknown" else r["season"]
        else:
            r = {"lead": p, "titles": {p.title}, "season": p.season}
            roles.append(r)
        known[shape] = want[p.posting_id] = (id(r), round(best, 6), r["lead"] is p)
    assert len({v[0] for v in got.values()}) == len(roles) > 20
    assert {i: v[1:] for i, v in want.items()}.keys() == got.keys()
    for i, (role, score, created) in want.items():
        assert abs(got[i][1] - score) < 2e-6 and got[i][2] == created
    assert len({(want[i][0], got[i][0]) for i in got}) == len(roles)


def test_sources(spark):
    one = lambda body: spark.createDataFrame([("s", body)], "source string, body string")
    lever = U.lever(one('[{"id":"a","text":"Intern","hostedUrl":"https://x/1","createdAt":1700000000000,"categories":{"location":"Oslo","team":"Core","department":"Eng"}},{"id":"b"}]')).collect()
    assert [(r["external_id"], r["location"], r["department"], r["published_at"]) for r in lever] == [("a", "Oslo", "Eng; Core", "2023-11-14 22:13:20")]
    ashby = U.ashby(one('{"jobs":[{"id":"1","title":"T","applyUrl":"https://x/2","publishedAt":"2024-02-03T04:05:06.000+00:00"}]}')).first()
    assert (ashby["url"], ashby["published_at"]) == ("https://x/2", "2024-02-03 04:05:06")
    smart = one('{"totalFound":9,"content":[{"id":"1","name":"A","ref":"https://r/1","location":{"city":"Rome","country":"it"}},{"id":"2","name":"B","ref":{"jobAd":"https://r/2"}}]}')
    assert [(r["url"], r["location"]) for r in U.smartrecruiters(smart).collect()] == [("https://r/1", "Rome, it"), ("https://r/2", None)]
    assert U.truncated(smart).count() == 1 and U.greenhouse(one("{broken")).count() == 0
    atom = '<feed><entry><id>e1</id><title>X</title><link rel="self" href="https://s"/><link rel="alternate" href="https://a"/><updated>2024-01-01T00:00:00Z</updated></entry></feed>'
    r = U.feed(one(atom)).first()
    assert (r["external_id"], r["url"], r["published_at"]) == ("e1", "https://a", None)
    maps = spark.createDataFrame([("r", "<sitemapindex><loc>c</loc><loc>r</loc></sitemapindex>"), ("c", "<urlset><loc>p1</loc><loc>p2</loc></urlset>")], "url string, body string")
    assert {x[0] for x in U.sitemap_walk(maps, "r").collect()} == {"p1", "p2"}
    tm = U.timemap(one('<https://o>; rel="original",\n<https://w/1>; rel="first memento"; datetime="Tue, 02 Jan 2024 03:04:05 GMT",')).collect()
    assert [(x["archive_url"], str(x["captured_at"])) for x in tm] == [("https://w/1", "2024-01-02 03:04:05")]
    page = '<script type="application/ld+json">{"@type":"JobPosting","title":"J","url":"https://j"}</script><a href="/jobs/7">Seven</a>'
    assert [(x["route"], x["title"]) for x in U.page_postings(one(page)).collect()] == [("json_ld", "J")]
    assert [(x["route"], x["url"]) for x in U.page_postings(one('<a class="b" href="/jobs/7"><b>Seven</b></a><a href="/about/x">A</a>')).collect()] == [("static_html", "/jobs/7")]


def test_robots(spark):
    body = "User-agent: bot\nUser-agent: other\nDisallow: /a\nAllow: /a/b\nDisallow: /*.pdf$\n\nUser-agent: *\nDisallow: /"
    rules = U.robots_rules(spark.createDataFrame([("h", body)], "host string, body string"))
    paths = spark.createDataFrame([("h", p) for p in ("/a/x", "/a/b/c", "/z.pdf", "/z.pdfx", "/q")], "host string, path string")
    got = lambda agent: {r["path"]: r["allowed"] for r in U.robots_allowed(rules, paths, agent, ["host"]).collect()}
    assert got("bot") == {"/a/x": False, "/a/b/c": True, "/z.pdf": False, "/z.pdfx": True, "/q": True}
    assert set(got("stranger").values()) == {False}


def test_text_functions(spark):
    import uuid

    df = spark.createDataFrame([("https://Jobs.Example.com/a/?utm_source=x&b=2&a=1#frag", "abc é def", "mail me at a@b.co or +1 (555) 123-4567, token = abc123")], "u string, t string, r string")
    r = df.select(T.identity_url(F.col("u")).alias("u"), T.bounded_utf8(F.col("t"), 5).alias("t"), T.redact(F.col("r")).alias("r"), T.uuid5(uuid.NAMESPACE_URL.hex, F.lit("x")).alias("id")).first()
    assert (r["u"], r["t"], r["r"], r["id"]) == ("https://jobs.example.com/a?a=1&b=2", "abc ", "mail me at [email] or [phone], token = [redacted]", str(uuid.uuid5(uuid.NAMESPACE_URL, "x")))


def test_interleave(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice("AAAB" if i % 3 else "BCDE"), i) for i in range(120)]
    out = Q.interleave(spark.createDataFrame(rows, "id bigint, company string, age bigint"), "company", [F.col("age")]).collect()
    names = [r["company"] for r in sorted((r for r in out if r["place"] is not None), key=lambda r: r["place"])]
    assert len(out) == 120 and all(names[max(0, i - Q.FEED_SPAN) : i].count(names[i]) < Q.FEED_MOST for i in range(len(names)))


def test_streams_give_what_the_tables_give(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    events.orderBy("ts").repartitionByRange(4, "ts").write.parquet(src)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = W.tumbling(stream, "ts", "1 day", ["event_type"], "value", "30 days").writeStream.outputMode("complete").format("memory").queryName("tumbling").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    key = lambda df: {(r["start"], r["event_type"]): (r["n"], round(r["total"], 4)) for r in df.collect()}
    assert key(spark.table("tumbling")) == key(W.tumbling(events, "ts", "1 day", ["event_type"], "value"))
    q = stream.select("user_id", "event_id", "ts").writeStream.foreachBatch(W.upsert_sink(out, "user_id", "ts")).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    import os

    last = spark.read.parquet(f"{out}/{sorted(os.listdir(out))[-1]}")
    want = events.groupBy("user_id").agg(F.max("ts").alias("ts"))
    assert {tuple(r) for r in last.select("user_id", "ts").collect()} == {tuple(r) for r in want.collect()}


def test_page_changes_in_a_stream(spark, tmp_path):
    rows = [("a", 1, "x"), ("a", 2, "x"), ("b", 1, "q"), ("a", 3, "y"), ("b", 4, "q"), ("a", 5, "x")]
    pages = spark.createDataFrame([(s, dt.datetime(2024, 1, 1, n), c) for s, n, c in rows], "source string, observed_at timestamp, content string")
    src = str(tmp_path / "in")
    pages.repartitionByRange(2, "observed_at").write.parquet(src)
    stream = spark.readStream.schema(pages.schema).parquet(src)
    q = W.page_changes(stream).writeStream.outputMode("append").format("memory").queryName("changes").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = sorted((r["source"], r["observed_at"].hour, r["kind"], r["previous"]) for r in spark.table("changes").collect())
    assert got == [("a", 1, "baseline", None), ("a", 3, "changed", "x"), ("a", 5, "changed", "y"), ("b", 1, "baseline", None)]


def test_seasons_are_whole_words_in_text_order(spark):
    titles = {"Fallback Systems Winter 2026": "winter-2026", "Spring or Summer Intern 2027": "spring-2027", "Autumn 2025 Analyst": "fall-2025", "Winterthur Office 2026": "unspecified-2026", "Summer Intern": None}
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    assert {r["t"]: r["k"] for r in df.select("t", T.cycle_key(F.col("t"), F.lit("unknown")).alias("k")).collect()} == titles


def test_epochs_of_any_length(spark):
    df = spark.createDataFrame([("999999999",), ("1700000000",), ("170000000000",), ("1700000000000",), ("soon",), (None,)], "v string")
    got = [r[0] and r[0].timestamp() for r in df.select(D.parse_timestamp(F.col("v"))).collect()]
    assert got == [999999999.0, 1700000000.0, 170000000.0, 1700000000.0, None, None]
