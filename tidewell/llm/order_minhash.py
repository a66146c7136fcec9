"""Order MinHash near-duplicate detection.

Each text becomes its five-word shingles, labelled by occurrence. A sketch draws
the ``DRAWN`` labelled shingles that are smallest under one hash function and
hashes them in text order, so two texts share it when the same shingles win and
stand in the same order: likeness of edit, not only of content. Texts that share
one of ``SKETCHES`` sketches are candidates, and a candidate pair is a link when
a banded alignment of the two shingle sequences covers at least ``MIN_LIKENESS``:
M / (n + m - M) for M aligned of n and m shingles. Classes are the connected
components of the links together with equal texts.

A bucket of texts that share a sketch is not expanded into pairs. Every member is
first compared with the bucket's leader, the member that shares most sketches
with other texts (an original shares more than its copies), and the components
of mixed buckets with two leaders more. Then the members of every bucket that
still lies in several components are joined by a prefix filter without loss: a
link has at least ``MIN_LIKENESS`` of its labelled shingles in common, so the two
texts share one of the rarest few of each. All pairs that do, and are in two
components, are aligned. No bucket is capped, and none is left unfinished.

Texts are known by a 64-bit hash (n texts collide with chance n^2 / 2^65).

Defined results: null counts as empty; texts without words match only equal
texts; a text of fewer than five words is one shingle; repeated rows and ties
are in one class, whose id is its smallest doc_id (null only if all are); an
empty table gives no rows.
"""

from __future__ import annotations

import functools
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.bytestext import blocks, mix, word_hashes
from tidewell.llm.graph import components
from tidewell.llm.sqlx import id_key
from tidewell.session import checkpoint_dir, gathered, materialize

SHINGLE = 5
DRAWN = 2
SKETCHES = 16
MIN_LIKENESS = 0.8
BAND = 0.25
#: Bins in which shingles are counted to find the rare ones. Any order of shingles gives the same links.
BINS = 1 << 18
#: Bits of the parity map that bounds what two texts have in common.
MAP = 256


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled shingle hashes of all texts in order, and the first of each (one more at the end)."""
    w, first = word_hashes(data, offsets)
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    start = np.concatenate([[0], np.cumsum(count)])
    total = int(start[-1])
    doc = np.repeat(np.arange(len(count)), count)
    at = first[doc] + np.arange(total) - start[doc]
    h = np.zeros(total, np.uint64)
    size = np.minimum(n, k)[doc]
    for i in range(k):
        on = i < size
        h = np.where(on, mix(h + w[np.minimum(at + i, len(w) - 1)] + np.uint64(i + 1)) if len(w) else h, h)
    key = h ^ mix(doc.astype(np.uint64) + np.uint64(0x51ED27))
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    fresh = np.ones(total, bool)
    fresh[1:] = sorted_key[1:] != sorted_key[:-1]
    head = np.flatnonzero(fresh)
    nth = np.empty(total, np.uint64)
    nth[order] = (np.arange(total) - np.repeat(head, np.diff(np.append(head, total)))).astype(np.uint64)
    return np.where(nth > 0, mix(h + nth * np.uint64(0x9E3779B97F4A7C15)), h), start


def sketch_block(data: np.ndarray, offsets: np.ndarray, sketches: int = SKETCHES, drawn: int = DRAWN) -> tuple[np.ndarray, np.ndarray]:
    """(rows x sketches hashes, shingles of each row); rows without shingles have zeros."""
    h, start = shingles(data, offsets)
    count = np.diff(start)
    rows = np.flatnonzero(count)
    out = np.zeros((len(count), sketches), np.uint64)
    if not len(rows):
        return out, count
    lead = start[rows]
    doc = np.repeat(np.arange(len(rows)), count[rows])
    rng = np.random.default_rng(5)
    odd = rng.integers(0, 1 << 63, sketches, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salt = rng.integers(0, 1 << 63, sketches, dtype=np.uint64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for j in range(sketches):
        v = (h ^ salt[j]) * odd[j]
        v ^= v >> np.uint64(32)
        v *= odd[j]
        value, place = [], []
        for _ in range(drawn):
            low = np.minimum.reduceat(v, lead)
            hit = np.flatnonzero(v == low[doc])
            _, one = np.unique(doc[hit], return_index=True)
            pos = hit[one]
            gone = low == top
            value.append(np.where(gone, np.uint64(0), h[pos]))
            place.append(np.where(gone, np.iinfo(np.int64).max, pos))
            v[pos] = top
        by_place = np.argsort(np.stack(place), axis=0, kind="stable")
        values = np.take_along_axis(np.stack(value), by_place, axis=0)
        acc = np.full(len(rows), np.uint64(j + 1))
        for row in values:
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + row)
        out[rows, j] = acc
    return out, count


def likeness(a: np.ndarray, b: np.ndarray, band: float = BAND) -> float:
    """Aligned share M / (n + m - M) of two labelled shingle sequences, inside a band of the diagonal."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    order = np.argsort(b)
    at = np.minimum(np.searchsorted(b[order], a), m - 1)
    found = b[order][at] == a
    j = order[at][found]
    i = np.flatnonzero(found)
    j = j[np.abs(i - j) <= max(16, int(band * max(n, m)))]
    if len(j) > 1 and (np.diff(j) < 0).any():
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        aligned = len(tails)
    else:
        aligned = len(j)
    return aligned / (n + m - aligned)


def sketched(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, node, n, sketches): the text's hash, its shingles and its sketches. One pass over the texts."""

    @F.arrow_udf("struct<n:int,s:array<bigint>>")
    def draw(texts: pa.Array) -> pa.Array:
        sizes, rows = [np.zeros(0, np.int32)], [np.zeros((0, SKETCHES), np.uint64)]
        for _, _, data, offsets in blocks(texts):
            s, n = sketch_block(data, offsets)
            rows.append(s)
            sizes.append(n.astype(np.int32))
        flat = np.concatenate(rows).view(np.int64).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, SKETCHES), pa.int32()), pa.array(flat))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(sizes), pa.int32()), lists], ["n", "s"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("node"), draw(text).alias("d")).select("id", "node", "d.n", F.col("d.s").alias("sketches"))


def verify(pairs: DataFrame, texts: DataFrame, min_likeness: float = MIN_LIKENESS) -> DataFrame:
    """The pairs (a, b) of nodes whose texts align well enough. ``texts``: (node, text), one row a node."""

    @F.arrow_udf("double")
    def align(x: pa.Array, y: pa.Array) -> pa.Array:
        out = np.zeros(len(x))
        last: tuple[str | None, np.ndarray | None] = (None, None)
        for k, (p, q) in enumerate(zip(x, y, strict=True)):
            p = p.as_py()
            if p != last[0]:
                last = (p, _sequence(p))
            out[k] = likeness(last[1], _sequence(q.as_py()))
        return pa.array(out)

    of = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}"))
    # Sorted by leader, so a task reads its words once.
    joined = pairs.join(of("b"), "b").join(of("a"), "a").sortWithinPartitions("a")
    return joined.select("a", "b", align("ta", "tb").alias("like")).where(F.col("like") >= min_likeness - 1e-9)


def _sequence(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return shingles(data, np.array([0, len(data)]))[0]


def links(drawn: DataFrame, texts: DataFrame, min_likeness: float = MIN_LIKENESS) -> tuple[DataFrame | None, DataFrame | None]:
    """(links, components) over distinct texts; None where no two texts share a sketch.

    ``drawn`` is a written table of ``sketched``; ``texts`` has (node, text)."""
    held = drawn.where("n > 0").select("node", "n", F.posexplode("sketches").alias("j", "s"))
    # Copies of one text are one member.
    members = held.groupBy("j", "s", "node").agg(F.first("n").alias("n"))
    shared = members.groupBy("j", "s").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    bucketed = materialize(gathered(members.join(shared, ["j", "s"])), "buckets")
    # Only texts with a candidate are shuffled again, and rounds read this table, not the corpus.
    texts = materialize(gathered(texts.join(bucketed.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])), "texts")
    # Pairs and links of all rounds lie in one table each, a partition a round, so plans don't grow with the rounds.
    root = f"{checkpoint_dir(texts.sparkSession)}/tidewell-rounds-{uuid.uuid4().hex}"
    tested: DataFrame | None = None
    found: DataFrame | None = None
    comp: DataFrame | None = None
    for turn, propose in enumerate((lambda: _first_pairs(bucketed), lambda: _mixed_pairs(bucketed, comp, found), lambda: _prefix_pairs(bucketed, texts, comp, min_likeness))):
        pairs = propose()
        close = F.least("n", "m") >= min_likeness * F.greatest("n", "m") - 1e-9
        pairs = pairs.where(close & (F.col("node") != F.col("leader"))).groupBy(F.least("node", "leader").alias("lo"), F.greatest("node", "leader").alias("hi")).agg(F.max("leader").alias("a"))
        pairs = pairs.select("lo", "hi", "a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b"))
        if tested is not None:
            pairs = pairs.join(tested.select("lo", "hi"), ["lo", "hi"], "left_anti")
        pairs, tested = _append(gathered(pairs), f"{root}/pairs", turn)
        new, linked = _append(gathered(verify(pairs.select("a", "b"), texts, min_likeness)), f"{root}/links", turn)
        if not new.isEmpty():
            # Components so far are stars, so the next ones are a step or two away.
            edges = new.select("a", "b") if comp is None else new.select("a", "b").union(comp.select("node", "component"))
            found, comp = linked, components(edges)
    return found, comp


def _append(df: DataFrame, path: str, turn: int) -> tuple[DataFrame, DataFrame]:
    """(the rows of this round, the rows of all rounds), written."""
    df.write.parquet(f"{path}/turn={turn}")
    read = df.sparkSession.read.schema(df.schema)
    return read.parquet(f"{path}/turn={turn}"), read.parquet(path).select(df.columns)


def _first_pairs(bucketed: DataFrame) -> DataFrame:
    """Every member with the member of its bucket that shares most sketches with other texts."""
    reach = bucketed.groupBy("node").agg(F.sum(F.log2("size")).alias("reach"))
    lead = bucketed.join(reach, "node").groupBy("j", "s").agg(F.max(F.struct("reach", F.xxhash64("node"), "node", "n")).alias("lead"))
    return bucketed.join(lead.select("j", "s", F.col("lead.node").alias("leader"), F.col("lead.n").alias("m")), ["j", "s"])


def _placed(bucketed: DataFrame, comp: DataFrame | None) -> DataFrame:
    """``bucketed`` with the component ``c`` of each node."""
    placed = bucketed if comp is None else bucketed.join(comp.withColumnRenamed("component", "c"), "node", "left")
    return placed.withColumn("c", F.col("node") if comp is None else F.coalesce("c", "node"))


def _mixed_pairs(bucketed: DataFrame, comp: DataFrame | None, found: DataFrame | None) -> DataFrame:
    """In buckets whose members lie in several components: one member of each component with two
    leaders, any one and the one with most links. It spares ``_prefix_pairs`` the easy links."""
    placed = _placed(bucketed, comp)
    placed = placed.withColumn("links", F.lit(0)) if found is None else placed.join(_degrees(found).withColumnRenamed("n_links", "links"), "node", "left")
    who = (F.col("node").alias("node"), F.col("n").alias("n"))
    drawn = F.struct(F.xxhash64("node", "j").alias("by"), *who)
    linked = F.struct(F.coalesce("links", F.lit(0)).alias("by"), F.xxhash64("node").alias("then"), *who)
    heads = placed.groupBy("j", "s", "c").agg(F.max(drawn).alias("any"), F.max(linked).alias("most"))
    leads = heads.groupBy("j", "s").agg(F.count(F.lit(1)).alias("parts"), F.max("any").alias("lead_any"), F.max("most").alias("lead_most")).where("parts > 1")
    both = heads.join(leads, ["j", "s"])
    pair = lambda x, y: F.struct(x["node"].alias("node"), x["n"].alias("n"), y["node"].alias("leader"), y["n"].alias("m"))
    return both.select(F.inline(F.array(pair(F.col("any"), F.col("lead_any")), pair(F.col("any"), F.col("lead_most")), pair(F.col("most"), F.col("lead_most")))))


def _prefix_pairs(bucketed: DataFrame, texts: DataFrame, comp: DataFrame | None, min_likeness: float) -> DataFrame:
    """Of all members of mixed buckets, every pair in two components that can be a link.

    A link of n >= m shingles has t * n and 2t / (1 + t) * m of them in common at least, so under
    any one order of all shingles its first common one is among the first n - t * n of the longer
    and the first m - 2t / (1 + t) * m of the shorter text (and one more). Rare ones come first,
    so shared boilerplate is behind that bound, or the texts are alike. Two bounds spare the join
    pairs that can't be links, and lose none: at the first common shingle no more is left than stands
    behind it in either text; and every bit in which two parity maps of all shingles differ is a
    shingle that only one of the texts has."""
    placed = _placed(bucketed, comp)
    mixed = placed.groupBy("j", "s").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("j", "s")
    nodes = placed.join(mixed, ["j", "s"], "left_semi").select("node", "c").distinct()
    open_texts = materialize(gathered(texts.join(nodes, "node")), "open")
    rows = open_texts.select("text").mapInArrow(_count_bins, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(BINS, np.int64)
    often[rows["bin"].to_numpy()] = rows["n"].to_numpy()
    long_share, short_share = min_likeness, 2 * min_likeness / (1 + min_likeness)
    ahead = lambda n, share: n - int(np.ceil(share * n - 1e-6)) + 1

    words = [f"w{k}" for k in range(MAP // 64)]

    @F.arrow_udf("struct<n:int,short:int,%s,keys:array<bigint>>" % ",".join(f"{w}:bigint" for w in words))
    def rarest(column: pa.Array) -> pa.Array:
        sizes, shorts, keys, ends, maps = [], [], [np.zeros(0, np.uint64)], [0], np.zeros((len(column), len(words)), np.int64)
        for v in column:
            h = _sequence(v.as_py())
            first = h[np.lexsort((h, often[(h % np.uint64(BINS)).astype(np.int64)]))][: ahead(len(h), long_share)]
            maps[len(sizes)] = parity(h)
            sizes.append(len(h))
            shorts.append(ahead(len(h), short_share))
            keys.append(first)
            ends.append(ends[-1] + len(first))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.array(shorts, pa.int32()), *[pa.array(m) for m in maps.T], lists], ["n", "short", *words, "keys"])

    each = open_texts.select("node", "c", rarest("text").alias("r")).select("node", "c", "r.n", "r.short", *[F.col(f"r.{w}") for w in words], F.posexplode("r.keys").alias("i", "key"))
    # A shingle in one component only, or first in no text, can give no pair.
    by_key = Window.partitionBy("key")
    index = F.col("i") < F.col("short")
    seen = each.select("node", "c", "n", "i", index.alias("index"), "key", *words, F.min("c").over(by_key).alias("lo"), F.max("c").over(by_key).alias("hi"), F.max(index).over(by_key).alias("any"))
    live = materialize(gathered(seen.where("lo <> hi and any").drop("lo", "hi", "any")), "prefixes")
    short = live.where("index").select("key", F.col("node").alias("leader"), F.col("n").alias("m"), F.col("c").alias("d"), F.col("i").alias("j"), *[F.col(w).alias(f"v{w}") for w in words])
    fits = (F.col("c") != F.col("d")) & (F.col("n") >= F.col("m")) & (F.col("m") >= min_likeness * F.col("n") - 1e-9)
    both = F.col("n") + F.col("m")
    common = F.lit(min_likeness / (1 + min_likeness)) * both - 1e-6
    differ = functools.reduce(Column.__add__, [F.bit_count(F.col(w).bitwiseXOR(F.col(f"v{w}"))) for w in words])
    fits = fits & (F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= common) & (both - differ >= 2 * common)
    return live.join(short, "key").where(fits).select("node", "n", "leader", "m").distinct()


def parity(h: np.ndarray) -> np.ndarray:
    """The parity of the shingles in each of ``MAP`` bins, as whole numbers of 64 bits."""
    odd = np.bincount((mix(h) % np.uint64(MAP)).astype(np.int64), minlength=MAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _count_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of a task's texts fall in each bin."""
    often = np.zeros(BINS, np.int64)
    for batch in batches:
        for _, _, data, offsets in blocks(batch["text"]):
            often += np.bincount((shingles(data, offsets)[0] % np.uint64(BINS)).astype(np.int64), minlength=BINS)
    used = np.flatnonzero(often)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(often[used])], ["bin", "n"])


def _degrees(found: DataFrame) -> DataFrame:
    return found.select(F.col("a").alias("node")).union(found.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))


def _classes(docs: DataFrame, id_col: str, text_col: str, min_likeness: float) -> DataFrame:
    """(id, node, c, n_links): one row for each document, ``c`` being the same in one class only."""
    drawn = materialize(sketched(docs, id_col=id_col, text_col=text_col), "sketches")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("node"), text.alias("text"))
    found, comp = links(drawn, texts, min_likeness)
    rows = drawn.select("id", "node")
    if found is None:
        return rows.select("id", "node", F.col("node").alias("c"), F.lit(0).cast("long").alias("n_links"))
    known = comp.join(_degrees(found), "node", "left")
    return rows.join(known, "node", "left").select("id", "node", F.coalesce("component", "node").alias("c"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def classify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_likeness: float = MIN_LIKENESS) -> DataFrame:
    """(id_col, node, class_id, n_links): one row for each document."""
    placed = _classes(docs, id_col, text_col, min_likeness)
    smallest = placed.groupBy("c").agg(F.min("id").alias("class_id"))
    return placed.join(smallest, "c").select(F.col("id").alias(id_col), "node", "class_id", "n_links")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_likeness: float = MIN_LIKENESS) -> DataFrame:
    """``docs`` with one row of each class: the one with the class's smallest id (null only if all are)."""
    # By class, not by id: unlike texts may have one id or none.
    first = _classes(docs, id_col, text_col, min_likeness).groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "node")).alias("f")).select("f.id", "f.node")
    stay = first.select(id_key(first, "id").alias("_k"), F.col("node").alias("_n"))
    # The row travels as one struct, so none of its names can clash.
    marked = docs.select(id_key(docs, id_col).alias("_k"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_n"), F.struct(*docs.columns).alias("_row"))
    return gathered(marked.join(stay, ["_k", "_n"], "left_semi").dropDuplicates(["_k", "_n"])).select(*[F.col("_row")[c].alias(c) for c in docs.columns])
