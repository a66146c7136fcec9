"""Language, quality, licence, codec, fingerprint, mixing and extraction operators on small tables."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.llm import fingerprints, html_extract, language_id, license_scan, mixing, quality_classifier, quality_rules, registry, sentencepiece_codec
from tidewell.llm.bytestext import blocks

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rule_counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    spots = {}
    for i in range(len(w) - 4):
        spots.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {k for at in spots.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_count_like_the_plain_version(spark, docs, odd_docs):
    extra = spark.createDataFrame([(900, "a b c d e a b c d e f g h i j"), (901, "x y " * 40), (902, "l1 a\nl1 a\n\nl2\nl1 a"), (903, None)], "doc_id bigint, text string")
    all_docs = docs.select("doc_id", "text").unionByName(extra).unionByName(odd_docs.where("doc_id >= 2 and doc_id <> 6").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    ratios = quality_rules.fit_log_ratio(docs, quality_rules.trusted(spark.read.parquet(f"{SF}/labels.parquet")))
    out = {r["doc_id"]: r for r in quality_rules.apply_rules(all_docs, ratios).collect()}
    for i, text in all_docs.collect():
        r = out[i]
        if i not in (1004, 1009):
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == rule_counts(text), i
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_quality_rules_ratio_is_the_smoothed_one(spark):
    df = spark.createDataFrame([(1, "good words here"), (2, "bad ### tokens"), (3, "good words again")], "doc_id bigint, text string")
    ratios = {r["bin"]: r["ratio"] for r in quality_rules.fit_log_ratio(df, df.where("doc_id = 1").select("doc_id"), buckets=64).collect()}
    bins = {r["doc_id"]: r["b"] for r in df.select("doc_id", quality_rules.ngram_bins(F.split("text", " "), 64).alias("b")).collect()}
    raw, hit = np.zeros(64), np.zeros(64)
    for i, b in bins.items():
        for x in b:
            raw[x] += 1
            hit[x] += i == 1
    want = np.log((hit + 1) / (hit.sum() + 64)) - np.log((raw + 1) / (raw.sum() + 64))
    assert np.allclose([ratios[i] for i in range(64)], want)


def test_quality_rules_count_every_trusted_document(spark):
    """Where all documents are trusted, target and raw corpus are the same, however many there are."""
    df = spark.range(20_500).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 7).alias("text"))
    ratios = quality_rules.fit_log_ratio(df, df.select("doc_id").union(df.select("doc_id")), buckets=64).collect()
    assert len(ratios) == 64 and all(abs(r["ratio"]) < 1e-12 for r in ratios)


def test_quality_rules_odd_rows(spark, odd_docs, no_docs):
    ratios = quality_rules.fit_log_ratio(odd_docs, odd_docs.select("doc_id"))
    out = quality_rules.apply_rules(odd_docs, ratios, keep=("doc_id", "_row", "_w")).collect()
    assert len(out) == odd_docs.count() and all(r["_w"] == "w" for r in out)
    assert all(r["base_failed"] and not r["kept"] for r in out if r["n_words"] == 0)
    assert quality_rules.apply_rules(no_docs, quality_rules.fit_log_ratio(no_docs, no_docs.select("doc_id"))).count() == 0


def test_language_of_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = registry.op3_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(d.select("doc_id", "lang"), "doc_id")
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.count("*").alias("n")).first()
    assert r["n"] > 100 and r["right"] >= 0.98


def test_language_odd_rows(spark, docs, odd_docs, no_docs):
    model = language_id.fit(docs)
    out = {(r["doc_id"], r["text"]): r for r in language_id.identify(odd_docs, model).collect()}
    assert all(out[k]["lang_pred"] == "und" and out[k]["lang_score"] == 0 for k in out if not any(ch.isalpha() for ch in k[1] or ""))
    assert all(0 <= r["lang_score"] <= 1 for r in out.values())
    assert language_id.accepted(language_id.identify(odd_docs, model)).columns == odd_docs.columns
    assert language_id.identify(no_docs, model).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd_docs, language_id.fit(no_docs)).collect()} == {"und"}
    one = language_id.identify(docs, language_id.fit(docs.where("lang = 'en'")))
    assert one.where("lang_pred <> 'en' and lang_pred <> 'und'").count() == 0


def test_quality_of_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    got = registry.op8_quality_classifier(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality"), "doc_id")
    r = got.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int")).alias("right"), F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r["n"] > 1000 and r["right"] >= 0.97 and 0 <= r["lo"] <= r["hi"] <= 1


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 5, 30).astype(float)
    y = n * np.clip(np.linspace(0, 1, 30) + rng.normal(0, 0.4, 30), 0, 1)
    at, value = quality_classifier.isotonic(np.arange(30.0), y, n)
    assert (np.diff(value) >= 0).all() and (np.diff(at) > 0).all()


def test_quality_classifier_odd_rows(spark, odd_docs, no_docs):
    s = quality_classifier.with_statistics(odd_docs)
    none = quality_classifier.fit(s, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert none is None
    assert {r["score"] for r in quality_classifier.score(s, none).collect()} == {0.5}
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, 1), (8, 0), (7, 0), (None, 1), (9, None)], "doc_id bigint, quality int")
    model = quality_classifier.fit(s, labels)
    out = quality_classifier.score(s, model).collect()
    assert len(out) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert quality_classifier.score(quality_classifier.with_statistics(no_docs), model).count() == 0


def test_licences_named_in_documents_are_found(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    names = {"apache": "Apache License, Version 2.0", "gpl": "GNU General Public License", "mit": "under the MIT License", "cc-by-nc": "CC BY-NC 4.0", "proprietary": "All rights reserved"}
    want = {r["doc_id"]: sorted({k for k, v in names.items() if v in r["text"]}) for r in d.collect()}
    got = {r["doc_id"]: r["families"].split(",") if r["families"] else [] for r in registry.op4_license_scans(spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == want.keys() and sum(map(bool, want.values())) > 20
    assert sum(got[k] == want[k] for k in want) / len(want) >= 0.998


def test_licence_odd_rows(spark, odd_docs, no_docs):
    model = license_scan.fit(no_docs)
    assert all(r["licenses"] == [] for r in license_scan.scan(odd_docs, model).where("text is null or text = ''").collect())
    text = "intro\n" + license_scan.TEMPLATES["bsd"][0] + "\n\nThis is plain prose about rivers, licences of anglers and the weather in spring."
    r = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), license_scan.fit(odd_docs)).first()["licenses"]
    assert [(x["paragraph"], x["family"], x["confirmed"]) for x in r] == [(1, "bsd", True)]
    assert license_scan.scan(no_docs, model).count() == 0


def test_wrapped_licences_are_found_once(spark, docs):
    import textwrap

    grant = license_scan.TEMPLATES["mit"][2] + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies."
    prose = "The river rises in spring and the anglers of the valley go out early.\n"
    rows = [(1, prose + "\n" + "\n".join(textwrap.wrap(grant, 70)) + "\n\n" + prose), (2, grant), (3, prose * 6), (4, prose + license_scan.TEMPLATES["apache"][0] + "\n" + prose)]
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), license_scan.fit(docs)).collect()}
    sure = {k: [(x["family"], x["paragraph"]) for x in v if x["confirmed"]] for k, v in got.items()}
    assert sure == {1: [("mit", 2)], 2: [("mit", 0)], 3: [], 4: [("apache", 1)]}


def coded(texts, dropout, salt=7):
    v = sentencepiece_codec.Vocabulary.read().ready()
    out = []
    for _, rows, data, offsets in blocks(pa.array(texts), sentencepiece_codec.BLOCK):
        ids, n = sentencepiece_codec.encode_block(v, data, offsets, np.full(rows, salt, np.uint64), dropout)
        ends = np.concatenate([[0], np.cumsum(n)])
        out += [ids[ends[i] : ends[i + 1]].tolist() for i in range(rows)]
    return out


def test_without_dropout_pieces_are_the_library_s(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    texts = [r["text"] for r in docs.select("text").collect()] + ["", " ", "  a  b ", "½ \n\n x\ty", "日本語 😀 a", "a" * 300 + " bb", "\n"]
    assert coded(texts, 0.0) == [sp.encode(t) for t in texts]


def test_the_heap_and_the_rounds_agree():
    v = sentencepiece_codec.Vocabulary.read().ready()
    for word in (" international", " Wahrscheinlichkeit", "  aaaaabbbb", " x", " ciónmente"):
        ids = sentencepiece_codec._with_unknown(v, np.array([ord(c) for c in word], np.uint32))
        for chunk in range(20):
            got, _ = sentencepiece_codec._segment(v, ids, np.array([len(ids)]), np.array([chunk], np.uint64), 0.3)
            assert got.tolist() == sentencepiece_codec.agenda(v, ids, chunk, 0.3)


def test_codec_gives_back_every_text(spark, docs, odd_docs, no_docs):
    for df in (docs.select("doc_id", "text"), odd_docs):
        c = sentencepiece_codec.encode(df, seed=3)
        back = c.withColumn("back", sentencepiece_codec.decoded(c, F.col("pieces")))
        assert back.where(~F.col("back").eqNullSafe(F.col("text"))).count() == 0
        assert back.where("text is null and pieces is not null").count() == 0
    a, b = ({r["doc_id"]: r["pieces"] for r in sentencepiece_codec.encode(docs, seed=s).collect()} for s in (1, 2))
    assert sum(a[k] != b[k] for k in a) > 0.9 * len(a)
    assert {r["doc_id"]: r["pieces"] for r in sentencepiece_codec.encode(docs.repartition(7), seed=1).collect()} == a
    assert sentencepiece_codec.encode(no_docs).count() == 0
    # Every occurrence of a word draws anew, in one text and in different ones.
    same = spark.createDataFrame([(k, "international " * 200) for k in range(3)], "doc_id bigint, text string")
    pieces = sentencepiece_codec.Vocabulary.read().pieces
    cuts = []
    for r in sentencepiece_codec.encode(same).collect():
        cuts.append({tuple(w.split("|")) for w in "|".join(pieces[i] for i in r["pieces"]).split("|▁")})
        assert len(cuts[-1]) > 8
    assert len(set.union(*cuts)) > len(cuts[0])
    with pytest.raises(ValueError, match="doc_id"):
        sentencepiece_codec.encode(docs, name="doc_id")


def test_a_text_is_encoded_once_however_many_functions_read_its_pieces(spark, docs):
    """Decoding in the same query must read the pieces, not encode again."""
    query = registry.op5_sentencepiece(spark, SF)
    plan = query._jdf.queryExecution().executedPlan().toString()
    calls = [x for x in plan.split("\n") if "ArrowEvalPython [" in x]
    assert sum(x.split("], [")[0].count("pieces(") for x in calls) == 1, plan
    rows = query.collect()
    sizes = {r["doc_id"]: len(r["pieces"]) for r in sentencepiece_codec.encode(docs).where("text is not null").collect()}
    assert len(rows) == docs.count() and all(r["lossless"] for r in rows)
    assert {r["doc_id"]: r["n_pieces"] for r in rows if r["doc_id"] in sizes} == sizes


def test_fingerprints_of_edited_texts(spark, docs, odd_docs, no_docs):
    for df in (docs.select("doc_id", "text"), odd_docs.where("doc_id is not null").select("doc_id", "text").dropDuplicates(["doc_id"])):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), reverse=True)
        got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(df).collect()}
        prints = {}
        for n, (i, text) in enumerate(rows):
            cut = len(text) // 3
            edited = text[: len(text) - cut] + rows[(n + 1) % len(rows)][1][:cut]
            r = got[i]
            assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            cells = lambda s: {s[k : k + 8] for k in range(0, len(s), 8)}
            a, b, c = cells(r["fingerprint"]), cells(r["edited_fingerprint"]), cells(got[rows[(n + 1) % len(rows)][0]]["fingerprint"])
            dice = lambda x, y: 1.0 if not x and not y else 2 * len(x & y) / (len(x) + len(y))
            assert abs(r["near_edited"] - dice(a, b)) < 1e-9 and abs(r["near_next"] - dice(a, c)) < 1e-9
            assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    assert fingerprints.fingerprint_edits(odd_docs).count() == odd_docs.count()
    assert fingerprints.fingerprint_edits(no_docs).count() == 0


def test_syncmers_are_context_free(spark):
    rng = random.Random(3)
    w = [f"q{rng.randrange(500)}" for _ in range(80)]
    rows = [(1, " ".join(w)), (2, " ".join(["new", "start", *w, "new", "end"]))]
    a, b = (set(r["a"]) for r in spark.createDataFrame(rows, "doc_id bigint, text string").select(fingerprints.anchors(F.col("text")).alias("a")).collect())
    assert a <= b and len(b - a) < 12


def test_raking_meets_the_marginals():
    rng = np.random.default_rng(7)
    codes = [rng.integers(0, k, 200) for k in (4, 3, 5)]
    tokens = rng.integers(1, 1000, 200)
    shares = [np.full(k, 1 / k) for k in (4, 3, 5)]
    w = mixing.rake(codes, tokens, shares)
    for c, s in zip(codes, shares, strict=True):
        assert np.allclose(np.bincount(c, weights=w) / tokens.sum(), s, atol=1e-6)
    f = mixing.calibrate(w / tokens, tokens, 0.5 * tokens.sum())
    assert np.isclose((tokens * np.minimum(1, f * w / tokens)).sum(), 0.5 * tokens.sum())


def test_mixing_by_tables_and_on_the_driver_agree(spark, docs, odd_docs, no_docs):
    rng = random.Random(9)
    rows = [(a, b, str(c), rng.randrange(0, 4000)) for a in "pqrs" for b in ("en", "de", "fr") for c in range(4)]
    table = mixing.materialize(spark.createDataFrame(rows, "source string, lang string, topic string, tokens bigint").withColumn("docs", F.lit(1)), "cells")
    key = lambda df: {(r["source"], r["lang"], r["topic"]): r["p"] for r in df.collect()}
    for share in (0.3, 0.9):
        a, b = key(mixing.probabilities(table, share=share)), key(mixing.probabilities(table, share=share, max_cells=3))
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-7 for k in a)
        assert abs(sum(r[3] * a[r[:3]] for r in rows) / sum(r[3] for r in rows) - share) < 1e-7
    out = mixing.mix(odd_docs)
    assert out.columns == [*odd_docs.columns, "mixed"] and out.where("p <> 'p' or topic <> 't' or kept <> 'y'").count() == 0
    assert out.count() == odd_docs.count() and out.where("mixed.p is null or mixed.kept is null").count() == 0
    assert mixing.mix(no_docs).count() == 0


def test_mixing_of_the_supplied_documents_is_the_plain_version(spark, docs):
    """Each row's probability and lot, worked out again from the query's own tokens and topics."""
    rows = registry.op6_mixing(spark, SF).collect()
    cell = lambda r: (r["source"] or mixing.NONE, r["lang"] or mixing.NONE, str(r["topic"]))
    tokens = {}
    for r in rows:
        tokens[cell(r)] = tokens.get(cell(r), 0) + r["n_tokens"]
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert all(r["n_tokens"] == len(WORD.findall(texts[r["doc_id"]])) for r in rows)
    total, w = sum(tokens.values()), {k: float(v) for k, v in tokens.items()}
    goals = []
    for d, c in enumerate(mixing.DIMENSIONS):
        now = {}
        for k, v in tokens.items():
            now[k[d]] = now.get(k[d], 0) + v
        raised = {k: v ** mixing.TEMPER[c] for k, v in now.items() if v}
        goals.append({k: v / sum(raised.values()) * total for k, v in raised.items()})
    for _ in range(200):
        for d in range(3):
            now = {}
            for k, v in w.items():
                now[k[d]] = now.get(k[d], 0) + v
            w = {k: v * goals[d][k[d]] / now[k[d]] if v else 0.0 for k, v in w.items()}
    low, high = 0.0, 1e6
    rate = {k: w[k] / tokens[k] for k in w if tokens[k]}
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(tokens[k] * min(1, mid * rate[k]) for k in rate) < mixing.SHARE * total else (low, mid)
    assert all(abs(r["p"] - (min(1, high * rate[cell(r)]) if cell(r) in rate else mixing.SHARE)) < 1e-6 for r in rows)
    lot = {r["doc_id"]: (r["h"] % (1 << 64) >> 11) / 2**53 for r in docs.select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id", F.xxhash64("text")).alias("h")).collect()}
    assert all(r["kept"] == (lot[r["doc_id"]] < r["p"]) for r in rows if abs(lot[r["doc_id"]] - r["p"]) > 1e-6)


def test_topics_tell_vocabularies_apart(spark):
    rng = random.Random(2)
    themes = [[f"{name}{i}word" for i in range(60)] for name in ("sea", "law", "code")]
    rows = [(k, " ".join(rng.choice(themes[k % 3]) for _ in range(80))) for k in range(90)] + [(900, None), (901, "a b c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["seen"]["topic"] for r in mixing.described(df, mixing.fit_topics(df, topics=3)).collect()}
    assert len({got[0], got[1], got[2]}) == 3 and all(got[k] == got[k % 3] for k in range(90)) and got[900] == got[901] == -1
    given = mixing.described(df.withColumn("t", F.lit("mine")), None, topic_col="t").first()["seen"]
    assert given["topic"] == "mine" and given["n_tokens"] > 0


def test_topics_are_learned_from_all_documents(spark):
    """2,300 texts with small hashes, and a theme that only texts with large hashes have; against plain k-means over all of them."""
    themes = [[f"{name}{i}word" for i in range(12)] for name in ("sea", "law", "code")]
    text = lambda k, t: " ".join(random.Random(k).choices(themes[t], k=60))
    h = F.xxhash64("doc_id", F.xxhash64("text"))
    many = spark.createDataFrame([(k, text(k, k % 2)) for k in range(4600)], "doc_id bigint, text string").where(h < 0)
    few = spark.createDataFrame([(k, text(k, 2)) for k in range(10_000, 10_080)], "doc_id bigint, text string").where(h > 0)
    df = many.union(few)
    weights = mixing.fit_topics(df, topics=3)
    assert np.array_equal(weights, mixing.fit_topics(df.repartition(7), topics=3))
    rows = mixing.described(df, weights).withColumn("h", h).orderBy("h").collect()
    own = {}
    for r in rows:
        own.setdefault(2 if r["doc_id"] >= 10_000 else r["doc_id"] % 2, set()).add(r["seen"]["topic"])
    assert len(rows) > 2100 and all(len(v) == 1 for v in own.values()) and len(set.union(*own.values())) == 3
    counts = []
    for _, n, data, offsets in blocks(pa.array([r["text"] for r in rows])):
        starts, ends, first = mixing.word_spans(data, offsets)
        counts += [np.bincount(mixing._bins(data, starts, ends)[first[i] : first[i + 1]], minlength=mixing.TOPIC_BINS) for i in range(n)]
    tf = np.array(counts, float)
    idf = np.log((1 + len(tf)) / (1 + (tf > 0).sum(0)))
    x = tf * idf
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    topic = np.array([r["seen"]["topic"] for r in rows])
    centre = np.stack([x[topic == k].sum(0) for k in range(3)])
    centre /= np.sqrt((centre * centre).sum(1, keepdims=True))
    assert np.allclose(weights, centre * idf, atol=1e-3) and ((x @ centre.T).argmax(1) == topic).all()


def test_pages_of_several_templates(spark):
    page = """<html><head><title>T</title><script>var x = "<p>no</p>";</script></head><body><header><nav><ul><li><a href=/>Home</a><li><a href=/b>About</a></ul></nav></header>
    <div class="sidebar"><p>Side {n}</p></div><main><article class="post"><header><h1>Title &amp; {n}</h1><p>by staff</p></header><p>First <b>bold</b>   text {n}.<p>Second&nbsp;par<br>agraph {n}</p>
    <div class="advert"><p>Buy {n}</p></div><form><p>Name</p></form><p>Third {n}</p><section id="comments"><p>me too {n}</p></section></article></main><footer><p>foot {n}</p></footer></body></html>"""
    plain = "<body><div><p>Only {n} words</p><p>and more {n}</p></div><div class='menu'><a href=x>a {n}</a></div>"
    rows = [(i, "https://A.example.com/x", page.replace("{n}", str(i))) for i in range(8)] + [(100 + i, "http://u@b.example.org:80/y", plain.replace("{n}", str(i))) for i in range(6)]
    rows += [(200, None, None), (201, "not a url", ""), (202, "https://c.example.com/", "just text & <i>more</i>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    for i in range(8):
        assert got[i] == f"Title & {i}\n\nFirst bold text {i}.\n\nSecond par agraph {i}\n\nThird {i}"
    for i in range(6):
        assert got[100 + i] == f"Only {i} words\n\nand more {i}"
    assert got[200] == "" and got[201] == "" and got[202] == "just text & more"
    assert html_extract.extract(df.limit(0)).count() == 0


def test_supplied_pages_give_their_articles(spark):
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    import html as H

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = [" ".join(H.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", body.replace("<br>", " "))]
        assert got[r["page_id"]] == "\n\n".join(x for x in want if x)


def extracted(spark, pages):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id bigint, url string, html string")
    return [r["text"] for r in html_extract.extract(df).orderBy("page_id").collect()]


def test_article_text_is_kept_whatever_names_and_repeats(spark):
    page = "<html><body class='single single-post has-sidebar'><nav><a href=/>Home</a></nav><article class='post share'><h1>Daily report</h1><p title=\"a > b\">Of day {n} much is told.</p><p>Same words.</p></article><footer>foot</footer>"
    for many in (1, 2, 4, 6):
        assert extracted(spark, [("https://x.example.org/a", page.replace("{n}", str(i))) for i in range(many)]) == [f"Daily report\n\nOf day {i} much is told.\n\nSame words." for i in range(many)]
    assert extracted(spark, [("https://x.example.org/a", page)] * 6) == ["Daily report\n\nOf day {n} much is told.\n\nSame words."] * 6
    five = "<body><article><h2>T</h2><ul>" + "<li>eq" * 5 + "</ul><p>tail {n}</article>"
    assert extracted(spark, [("https://y.example.org/", five.replace("{n}", str(i))) for i in range(3)]) == ["\n\n".join(["T", *["eq"] * 5, f"tail {i}"]) for i in range(3)]


def test_pages_without_an_article_element(spark):
    page = """<body><div><p>Welcome to the site of this and that.</p></div><div><h1>Head {n}</h1><div><p>First {n} goes on for a while with many words in it.</p><div><p>Inner {n}</p></div><p>Last {n} with a few more words again.</p></div></div>
    <div><p>Ask us {n}</p></div><div class="comments"><p>a very long comment by a reader, longer than the article itself, {n} and on and on and on and on and on and on and on and on and on and on</p></div></body>"""
    got = extracted(spark, [("https://z.example.org/", page.replace("{n}", str(i))) for i in range(5)])
    assert got == [f"Head {i}\n\nFirst {i} goes on for a while with many words in it.\n\nInner {i}\n\nLast {i} with a few more words again." for i in range(5)]


def test_folds_are_balanced_and_of_any_length(spark):
    unit = "".join(f"<section><h3>a</h3><div><p>x{i}</p></div></section><ol><li>u</ol>" if i % 3 else f"<dl><dt>t<dd>x{i}</dl>" for i in range(12))
    nodes, blocks = html_extract.parse("<body>" + unit * 3 + "<p>end")
    syms = [x[0] for x in nodes]
    depth = np.cumsum([0 if "#" in s or "@" in s else -1 if s == "/" else 1 for s in syms])
    assert depth[-1] == 0 and (depth >= 0).all() and sum(x[1] for x in nodes) == sum(x[2] for x in nodes) > 0
    assert len(blocks) == 3 * (8 * 3 + 4 * 2) + 1 and all("#" in syms[k] for k, _ in blocks)
    assert len(nodes) < 60


def test_many_streams_of_one_host(spark):
    pages = [("https://h.example.org/", "<body><nav><a href=/>N</a></nav><article><h1>T</h1>" + "".join(f"<p>p {i} {j}</p><{'ul' if i >> j & 1 else 'ol'}><li>q</{'ul' if i >> j & 1 else 'ol'}>" for j in range(7)) + "</article>") for i in range(128)]
    got = extracted(spark, pages)
    assert got == ["\n\n".join(["T", *(x for j in range(7) for x in (f"p {i} {j}", "q"))]) for i in range(128)]


def test_wrappers_are_union_free(spark):
    a, b = "html body div p#0 / / /", "html body div (p#0)+ ul (li#0)+ / / / /"
    nodes = lambda s: [{"sym": x, "opens": o, "closes": c, "optional": False, "low": k, "high": k + 1, "first": 1, "last": 2, "chars": 5} for k, (x, o, c) in enumerate(html_extract.read(s))]
    assert html_extract.express(html_extract.align(nodes(a), nodes(b))) == "html body div (p#0)+ ul? (li#0)+? / / / /?"


def _site(spark, page):
    """The texts of six pages of one host, ``page(i)`` each."""
    df = spark.createDataFrame([(i, f"https://names.example.com/{i}", page(i)) for i in range(6)], "page_id bigint, url string, html string")
    return [r["text"] for r in html_extract.extract(df).orderBy("page_id").collect()]


def _story(i, n=4):
    return [f"Paragraph {k} of story {i} tells what happened to {['ann', 'bob', 'cy', 'di', 'ed', 'flo'][(i + k) % 6]} on day {i * 7 + k}." for k in range(n)]


_MENU = "<div class='menu'><a href='/'>Home</a> <a href='/a'>About</a></div>"
_NOTE = "<div class='comments'><p>Reader {0} says it is rubbish</p><p>Reader {0}{0} agrees</p></div>"


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("<div class='content has-sidebar'>", "</div>"), ("<main><section class='story share'>", "</section></main>"), ("<div class='legal'>", "</div>"), ("<div class='comments-page'>", "</div>"),
        ("<article><section class='legal'>", "</section></article>"), ("<article><div class='promo-free'>", "</div></article>"), ("<div class='page no-ads'><div class='side'>", "</div></div>"),
    ],
)
def test_html_names_never_erase_an_article(spark, before, after):
    page = lambda i: f"<body>{_MENU}{before}<h1>Headline {i}</h1>{''.join(f'<p>{p}</p>' for p in _story(i))}{after}<div class='footer'>All rights</div></body>"
    assert _site(spark, page) == ["\n\n".join([f"Headline {i}", *_story(i)]) for i in range(6)]


def test_html_parts_of_an_article(spark):
    def page(i):
        a, b, c, d = _story(i)
        head = f"<header><h1>Headline {i}</h1><p>{a}</p><div class='byline'>By {i}</div></header>"
        return f"<body>{_MENU}<article>{head}<p class='side note'>{b}</p><p>{c}</p><div class='notice'>Read our terms</div><p>{d}</p><div class='advert'>Buy {i} now</div>{_NOTE.format(i)}</article></body>"

    assert _site(spark, page) == ["\n\n".join([f"Headline {i}", *_story(i)]) for i in range(6)]


def test_html_repeated_and_linked_paragraphs_beside_fields(spark):
    def page(i):
        a, b, _, _ = _story(i)
        return f"<body>{_MENU}<div class='x'><h2>Daily report</h2><p>{a}</p><h3>Part {i}</h3><p>{b}</p><h4>Links</h4><p><a href='/{i}'>All about story {i} and its many sequels</a></p><h5>End</h5><blockquote>That is all for today.</blockquote></div><div>Imprint</div></body>"

    assert _site(spark, page) == ["\n\n".join(["Daily report", _story(i)[0], f"Part {i}", _story(i)[1], "Links", f"All about story {i} and its many sequels", "End", "That is all for today."]) for i in range(6)]


def test_html_many_unlike_children_and_odd_tables(spark):
    import time

    start = time.time()
    nodes, blocks = html_extract.parse("<body>" + "".join(f"<x{k}>t{k}</x{k}>" for k in range(50_000)))
    assert len(blocks) == 50_000 and time.time() - start < 5
    rows = [(1, "https://o.example.com/1", "<article><p>same</p></article>", "t")] * 2 + [(None, None, None, None), (2, "", "", "")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, _row string").withColumn("_host", F.lit("h")).withColumn("_p", F.lit("p")), keep=("page_id", "_row", "_host", "_p"))
    assert sorted((r["page_id"] or 0, r["text"]) for r in got.collect()) == [(0, ""), (1, "same"), (1, "same"), (2, "")]
