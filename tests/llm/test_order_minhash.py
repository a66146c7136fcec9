"""Near-duplicate classes against the exact Jaccard of all pairs, and the alignment against a plain one."""

import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import order_minhash as O
from tidewell.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def shingle_set(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def corpus(rng, groups=40):
    words = [f"v{i}" for i in range(400)]
    out, k = [], 0
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append((k, " ".join(w)))
            k += 1
    return out


def test_every_pair_above_the_bound_is_in_one_class(spark):
    rows = corpus(random.Random(8))
    sets = {k: shingle_set(t) for k, t in rows}
    got = {r["doc_id"]: r["class_id"] for r in O.classify(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    assert len(pairs) > 50
    assert all(got[a] == got[b] for a, b in pairs)
    # Classes are no wider than chains of such pairs.
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert {k: find(k) for k in sets} == got


def test_alignment_is_the_longest_common_run():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a = rng.permutation(40)[:30].astype(np.uint64)
        b = np.concatenate([a[: rng.integers(5, 25)], rng.integers(100, 130, 3).astype(np.uint64), a[rng.integers(5, 25) :]])
        _, keep = np.unique(b, return_index=True)
        b = b[np.sort(keep)]
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        m = t[-1, -1]
        assert abs(O.likeness(a, b, band=1.0) - m / (len(a) + len(b) - m)) < 1e-12


def test_a_hub_and_its_copies_are_one_class(spark):
    """Copies that are like the original but not like each other."""
    rng = random.Random(5)
    base = [f"t{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 80):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(150)] = f"z{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    base_set = shingle_set(rows[0][1])
    like = [k for k, t in rows if len(base_set & shingle_set(t)) / len(base_set | shingle_set(t)) >= 0.8]
    got = {r["doc_id"]: r["class_id"] for r in O.classify(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(like) > 40 and all(got[k] == 0 for k in like)


def test_links_that_meet_only_in_a_large_bucket_are_found(spark):
    """300 unlike texts share boilerplate and one sketch; 12 pairs among them are alike and share no other."""
    rng = random.Random(3)
    boilerplate = [f"b{i}" for i in range(140)]
    texts = []
    for k in range(300):
        own = [f"u{k}x{i}" for i in range(60)]
        texts.append(boilerplate + own)
        if k % 25 == 0:
            texts.append(boilerplate + own[:55] + [f"w{k}x{i}" for i in range(5)])
    rng.shuffle(texts)
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    drawn = O.materialize(O.sketched(docs).selectExpr("id", "node", "n", "array(7L, xxhash64(node, 'alone')) as sketches"))
    found, _ = O.links(drawn, docs.selectExpr("xxhash64(text) as node", "text"))
    sets = [shingle_set(" ".join(w)) for w in texts]
    want = {(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    at = {r["node"]: r["id"] for r in drawn.collect()}
    assert len(want) == 12
    assert {(max(at[r["a"]], at[r["b"]]), min(at[r["a"]], at[r["b"]])) for r in found.collect()} == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (10, 11), (20, 20), (11, 12), (30, 7), (7, 6)]
    got = defaultdict(set)
    for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect():
        got[r["component"]].add(r["node"])
    assert dict(got) == {1: {1, 2, 3, 4, 5, 6, 7, 30}, 10: {10, 11, 12}}


def test_odd_rows(spark, odd_docs, no_docs):
    got = O.classify(odd_docs).collect()
    assert len(got) == odd_docs.count()
    classes = defaultdict(set)
    for r in got:
        classes[r["node"]].add(r["class_id"])
    assert all(len(v) == 1 for v in classes.values())
    kept = O.dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    assert sum(r["doc_id"] == 4 for r in rows) == 1
    assert O.dedup(no_docs).count() == 0


def test_one_row_of_every_class_stays(spark):
    """Also where unlike texts share one id, or have none."""
    of = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    near = of("a").replace("a39", "z39")
    rows = [(9, of("a")), (9, of("b")), (12, near), (None, of("c")), (None, of("d")), (None, of("d")), (None, of("b")), (3, of("e")), (3, of("e")), (5, None), (None, "")]
    kept = O.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["text"] or "", r["doc_id"]) for r in kept) == sorted([(of("a"), 9), (of("b"), 9), (of("c"), None), (of("d"), None), (of("e"), 3), ("", 5)], key=lambda r: r[0])


def test_odd_rows_keep_one_of_every_class(odd_docs):
    texts = sorted({r["text"] or "" for r in odd_docs.collect()})
    node = {t: i for i, t in enumerate(texts)}
    got = O._classes(odd_docs, "doc_id", "text", O.MIN_LIKENESS).collect()
    kept = O.dedup(odd_docs).collect()
    assert len(kept) == len({r["c"] for r in got})
    assert len({node[r["text"] or ""] for r in kept}) == len(kept)


def test_bounds_of_the_prefix_join_lose_no_link():
    """Parity maps never say that two texts differ in more shingles than they do."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        a, b = (rng.choice(pool, rng.integers(1, 300), replace=False) for _ in range(2))
        apart = sum(int(x).bit_count() for x in np.bitwise_xor(O.parity(a), O.parity(b)).view(np.uint64))
        assert apart <= len(set(a.tolist()) ^ set(b.tolist()))


def test_many_near_copies_without_their_original(spark):
    """Copies with few edits of one base, compared with every pair."""
    rng = random.Random(21)
    base = [f"t{i}" for i in range(110)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.choice((1, 2, 2, 3, 3))):
            w[rng.randrange(110)] = f"z{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    sets = {k: shingle_set(t) for k, t in rows}
    got = {r["doc_id"]: r["class_id"] for r in O.classify(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert pairs and sum(got[a] == got[b] for a, b in pairs) == len(pairs)


def test_recall_against_all_pairs_of_the_supplied_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in docs.collect()}
    by = defaultdict(list)
    for k, v in sets.items():
        for x in v:
            by[x].append(k)
    common = defaultdict(int)
    for ks in by.values():
        for a in ks:
            for b in ks:
                if a < b:
                    common[a, b] += 1
    pairs = [(a, b) for (a, b), n in common.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    got = {r["doc_id"]: r["class_id"] for r in O.classify(docs).collect()}
    assert len(pairs) > 20 and sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)


def test_ids_of_any_kind(spark):
    text = " ".join(f"a{i}" for i in range(40))
    rows = [("x", text), ("k", text), (None, text.replace("a39", "z")), (None, "other words"), ("b", None)]
    kept = O.dedup(spark.createDataFrame(rows, "doc_id string, text string").withColumn("_k", F.lit("mine"))).collect()
    assert sorted((r["doc_id"] or "", r["text"] or "", r["_k"]) for r in kept) == [("", "other words", "mine"), ("b", "", "mine"), ("k", text, "mine")]
