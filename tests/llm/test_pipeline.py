"""The pipeline's stages against what each operator gives on its own input."""

import random
import re
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import functions as F

import corpus_pipeline as P
from tidewell.llm import language_id, sentencepiece_codec
from tidewell.session import checkpoint_dir, materialize
from test_line_dedup import WORD, plain
from test_order_minhash import shingle_set

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in P.STAGES:
        seen.append(materialize(stage(spark, seen[-1], SF), name))
    assert [n for n, _ in P.STAGES] == ["language", "line_dedup", "near_dedup", "mixing", "encode"]
    for df in seen[1:-1]:
        assert df.columns == docs.columns and df.join(seen[seen.index(df) - 1], "doc_id", "left_anti").count() == 0
    spoken, lines, near, mixed, pieces = seen[1:]
    judged = language_id.identify(docs, language_id.fit(docs.where(~language_id.held_out(4, 2))))
    assert spoken.count() == language_id.accepted(judged).count() >= 0.98 * docs.count()
    rows = [(r["doc_id"], r["text"]) for r in spoken.collect()]
    gone = plain(rows)
    want = {k: "\n".join(x for p, x in enumerate(t.split("\n")) if (k, p) not in gone) for k, t in rows}
    want = {k: t for k, t in want.items() if WORD.search(t) or not any(o[0] == k for o in gone)}
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == want
    sets = {k: shingle_set(t) for k, t in want.items()}
    left = {r["doc_id"] for r in near.collect()}
    twins = {b for a in sets for b in sets if a < b and (want[a] == want[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0)}
    assert left == set(sets) - twins
    assert 0.4 * len(left) < mixed.count() <= len(left)
    back = pieces.join(mixed.select("doc_id", "text"), "doc_id").withColumn("back", sentencepiece_codec.decoded(pieces, F.col("pieces")))
    assert back.count() == mixed.count() and back.where("back <> text").count() == 0


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    own = ("lang_pred", "lang_score", "n_lines", "n_dropped", "n_near", "n_tokens", "_lang", "_told", "_mixed", "pieces")
    for docs in (odd_docs.withColumns({c: F.lit("mine") for c in own}), no_docs, odd_docs.drop("n_chars")):
        df = docs
        for name, stage in P.STAGES:
            before, df = df, materialize(stage(spark, df, SF), name)
            assert df.count() <= before.count()
            if name != "encode":
                assert df.columns == docs.columns and df.join(before, "doc_id", "left_anti").where("doc_id is not null").count() == 0
                # No stage touches a caller's column.
                assert all(r[c] == before_value for r in df.collect() for c, before_value in (("p", "p"), ("topic", "t"), ("kept", "y"), *((c, "mine") for c in own if c in docs.columns)))
            if name == "language":
                assert all(any(ch.isalpha() for ch in r["text"] or "") for r in df.collect())


def test_mixing_keeps_a_rare_theme_wherever_its_hashes_lie(spark):
    """Topics come from all documents: 40 texts of their own theme, with large hashes among 2,300 others, get a topic's tempered share."""
    themes = [[f"{name}{i}word" for i in range(12)] for name in ("sea", "law", "code")]
    text = lambda k, t: " ".join(random.Random(k).choices(themes[t], k=60))
    h = F.xxhash64("doc_id", F.xxhash64("text"))
    many = spark.createDataFrame([(k, text(k, k % 2)) for k in range(4600)], "doc_id bigint, text string").where(h < 0)
    few = spark.createDataFrame([(k, text(k, 2)) for k in range(10_000, 10_080)], "doc_id bigint, text string").where(h > 0)
    docs = materialize(many.union(few).withColumn("lang", F.lit("en")).withColumn("source", F.lit("web")), "themes")
    kept = P.mixture(spark, docs, SF)
    rare = "doc_id >= 10000"
    assert docs.count() > 2100 and kept.where(rare).count() == docs.where(rare).count() > 20
    assert kept.where(f"not {rare}").count() < 0.8 * docs.where(f"not {rare}").count()


def test_tables_are_written_in_few_files_however_many_partitions_are_shuffled(spark, tmp_path):
    """A file a core, not one a shuffle partition: on local disks executors start processes for each file."""
    many = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in many}
    text = lambda k: "\n".join(" ".join(random.Random(7 * k // 2 + i).choices(["sea", "law", "code", "tide", "well", "mill"], k=12)) for i in range(4))
    docs = materialize(spark.createDataFrame([(k, text(k), "en", "web") for k in range(600)], "doc_id bigint, text string, lang string, source string").repartition(16), "few")
    written = []
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        before = set(Path(urlparse(checkpoint_dir(spark)).path).rglob("part-*.parquet"))
        for name, stage in P.STAGES[1:3]:
            out = stage(spark, docs, SF)
            out.write.parquet(str(tmp_path / name))
            docs = spark.read.schema(out.schema).parquet(str(tmp_path / name))
            written += (tmp_path / name).glob("part-*.parquet")
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    written += set(Path(urlparse(checkpoint_dir(spark)).path).rglob("part-*.parquet")) - before
    files = Counter(p.parent for p in written)
    scanned = [n for d, n in files.items() if re.search("-(lines|sketches)-", str(d))]  # as many as the splits of what is read
    assert docs.count() > 100 and len(files) > 10
    assert max(n for d, n in files.items() if not re.search("-(lines|sketches)-", str(d))) <= spark.sparkContext.defaultParallelism and max(scanned) <= 16
