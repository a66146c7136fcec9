"""Line dedup within one word of edit, by deletion neighbourhoods.

A line is its words, lower-cased. Of all lines within ``MAX_EDITS`` = 1 word of
each other (one word replaced, added or missing) and of all equal lines, every
line goes that has an earlier one, in order of doc_id and place. The steps:

1. Equal lines meet by a 128-bit hash; the earliest occurrence is found.
2. A filter without loss: a line is cut in ``SEGMENTS`` stretches of words and
   hashed without each of them. Two lines within one word agree in one of these
   keys, so a line that shares no key with a different line needs no variants.
3. The rest emit every variant with one word deleted, from the stretches whose
   key was shared, and the whole line. Equal variants with the word missing at
   the same place, or missing in one only, are the lines within one word; the
   edit distance is checked from their lengths and places.
4. Each line meets only the earliest member of a group, never all others.

Lines without a word always stay. Lines of fewer than ``min_words`` words stay
too (``MIN_WORDS`` = 1: none of them), lines of fewer than ``min_fuzzy`` are compared
for equality only (``MIN_FUZZY`` = 3: of two words, one edit leaves half a line).
Lines of ``SHORT`` words or fewer have too few words for the filter of step 2 and
emit all their variants.

Defined results: a null text has no lines and stays null; rows equal in doc_id
and text are one occurrence, so repeated rows keep the same lines; null ids come
last; ids may have any type that can be ordered; a text all of whose lines go is
the empty text; other columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.bytestext import blocks, mix, span_hashes, word_spans
from tidewell.llm.sqlx import id_key, unused
from tidewell.session import discard, gathered, materialize, release

MIN_WORDS = 1
MIN_FUZZY = 3
SEGMENTS = 4
#: Words from which on a line can be cut in SEGMENTS stretches with one to spare.
SHORT = SEGMENTS + 1
_M1, _M2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_INV = {m: np.uint64(pow(int(m), -1, 1 << 64)) for m in (_M1, _M2)}


class _Sums:
    """Hashes of any stretch of a sequence of word hashes, from running sums."""

    def __init__(self, w: np.ndarray, m: np.uint64):
        n = len(w)
        ones = np.full(n + 1, m, np.uint64)
        ones[0] = 1
        self.power = np.cumprod(ones, dtype=np.uint64)
        ones[1:] = _INV[m]
        self.inverse = np.cumprod(ones, dtype=np.uint64)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(w ^ m) * self.power[:n], out=self.total[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of words a .. b - 1, independent of where the stretch stands; additive with ``after``."""
        return (self.total[b] - self.total[a]) * self.inverse[a]

    def without(self, a: np.ndarray, p: np.ndarray, q: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of words a .. p - 1 followed by q .. b - 1."""
        return mix(self.of(a, p) + self.of(q, b) * self.power[p - a] + (b - q + p - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of a block: text, place in it, first word, end of words; and the word hashes."""
    starts, ends, _ = word_spans(data, offsets)
    w = span_hashes(data, starts, ends)
    breaks = np.flatnonzero(data == 0x0A)
    heads = np.concatenate([offsets[:-1], breaks + 1])
    doc = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((heads, doc))
    heads, doc = heads[order], doc[order]
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    begin = np.searchsorted(starts, heads)
    return doc, place, begin, np.append(begin[1:], len(starts)), w


def _stretches(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words a stretch has, for a line as the shorter and as the longer of a pair."""
    return (n - 1) // SEGMENTS, (n - 2) // SEGMENTS


def describe(texts: pa.Array, min_words: int = MIN_WORDS, min_fuzzy: int = MIN_FUZZY) -> pa.Array:
    """Each text's lines of ``min_words`` words or more: place, words, 128-bit hash and the filter's keys."""
    columns: dict[str, list[np.ndarray]] = {c: [] for c in ("pos", "n", "h1", "h2", "per", "keys")}
    lines_of = np.zeros(len(texts), np.int64)
    for row, _, data, offsets in blocks(pc.utf8_lower(texts)):
        doc, place, begin, stop, w = _lines(data, offsets)
        real = stop - begin >= max(1, min_words)
        doc, place, begin, stop = doc[real], place[real], begin[real], stop[real]
        n = stop - begin
        np.add.at(lines_of, row + doc, 1)
        one, two = _Sums(w, _M1), _Sums(w, _M2)
        short, long = _stretches(n)
        table = np.zeros((len(n), 2 * SEGMENTS), np.uint64)
        for side, q in enumerate((short, long)):
            q = np.maximum(q, 0)
            for i in range(SEGMENTS):
                away = one.without(begin, begin + i * q, stop - (SEGMENTS - 1 - i) * q, stop)
                table[:, side * SEGMENTS + i] = mix(away + (q * SEGMENTS + i).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
        used = np.zeros(table.shape, bool)
        used[:, :SEGMENTS] = (n >= max(min_fuzzy, SHORT))[:, None]
        used[:, SEGMENTS:] = ((n >= max(min_fuzzy, SHORT + 1)) & (short != long))[:, None]
        found = {"pos": place, "n": n, "h1": one.without(begin, stop, stop, stop), "h2": two.without(begin, stop, stop, stop), "per": used.sum(1), "keys": table[used]}
        for c, v in found.items():
            columns[c].append(v)
    whole = {c: np.concatenate([np.zeros(0, v[0].dtype if v else np.int64), *v]) for c, v in columns.items()}
    ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    signed = lambda c: pa.array(whole[c].astype(np.uint64).view(np.int64))
    keys = pa.ListArray.from_arrays(ends(whole["per"]), signed("keys"))
    rows = pa.StructArray.from_arrays([pa.array(whole["pos"], pa.int32()), pa.array(whole["n"], pa.int32()), signed("h1"), signed("h2"), keys], ["pos", "n", "h1", "h2", "keys"])
    return pa.ListArray.from_arrays(ends(lines_of), rows)


_LINES = "array<struct<pos:int,n:int,h1:bigint,h2:bigint,keys:array<bigint>>>"


def variants_of(line: str, stretches: list[int]) -> list[tuple[int, int, int]]:
    """(hash, hash, place) of the line without one word of the given stretches, and of the whole line (place -1)."""
    data = np.frombuffer(line.encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    w = span_hashes(data, starts, ends)
    n = len(w)
    places = set()
    for s in stretches:
        q = int(_stretches(np.array([n]))[s // SEGMENTS][0])
        i = s % SEGMENTS
        places.update(range(i * q, n - (SEGMENTS - 1 - i) * q))
    p = np.array(sorted(places), np.int64)
    zero, end = np.zeros(len(p), np.int64), np.full(len(p), n)
    whole = np.array([0]), np.array([n])
    out = [np.concatenate([s.without(zero, p, p + 1, end), s.without(whole[0], whole[1], whole[1], whole[1])]).view(np.int64) for s in (_Sums(w, _M1), _Sums(w, _M2))]
    return list(zip(out[0].tolist(), out[1].tolist(), [*p.tolist(), -1], strict=True))


def _packed(text: Column) -> Column:
    """A text compressed, for the way through a shuffle; null stays null."""

    @F.arrow_udf("binary")
    def pack(texts: pa.Array) -> pa.Array:
        codec = pa.Codec("zstd", compression_level=1)
        raw = (None if v is None else v.encode("utf-8", "surrogatepass") for v in texts.to_pylist())
        return pa.array([None if r is None else len(r).to_bytes(8, "little") + codec.compress(r, asbytes=True) for r in raw], pa.binary())

    return pack(text)


def _unpack(packed: bytes | None) -> str | None:
    if packed is None:
        return None
    return pa.Codec("zstd").decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True).decode("utf-8", "surrogatepass")


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    return docs.select(id_key(docs, id_col).alias("_k"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_t"), *more)


def _order() -> Column:
    return F.struct(F.col("_k").alias("k"), F.col("pos").alias("pos"), F.col("_t").alias("t"))


def drops(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_fuzzy: int = MIN_FUZZY) -> DataFrame:
    """(_k, _t, gone): places of the lines that go, for the texts that lose any; a written table."""
    keyed = _keyed(docs, id_col, text_col, F.col(text_col).alias("_x"))
    read = F.arrow_udf(lambda texts: describe(texts, min_words, min_fuzzy), _LINES)
    lines = materialize(keyed.select("_k", "_t", F.explode(read(F.coalesce(F.col("_x"), F.lit("")))).alias("l")).select("_k", "_t", "l.*"), "lines")
    # One row a distinct line, written, so that a very common line is one row in all that follows.
    equal = lines.groupBy("h1", "h2").agg(F.min(_order()).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    firsts = materialize(gathered(equal), "firsts")
    # The filter: keys that two different lines share. Every table is written before the next one is
    # shuffled: one shuffle's files at a time, and joins of plain tables, whose hot keys Spark can split.
    release(docs.sparkSession)
    keys = firsts.select("h1", "h2", F.posexplode("keys").alias("stretch", "key"))
    shared = materialize(gathered(keys.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("key")), "shared")
    release(docs.sparkSession)
    each = F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("stretch")
    short = firsts.where(F.col("n").between(min_fuzzy, SHORT)).select("h1", "h2", each)
    live = keys.join(shared, "key").select("h1", "h2", "stretch").union(short).groupBy("h1", "h2").agg(F.collect_set("stretch").alias("stretches"))
    chosen = live.join(firsts, ["h1", "h2"]).select(F.col("first.k").alias("_k"), F.col("first.t").alias("_t"), F.struct(F.col("first.pos").alias("pos"), "h1", "h2", "stretches").alias("l"))
    by_text = materialize(gathered(chosen.groupBy("_k", "_t").agg(F.collect_list("l").alias("lines"))), "chosen")
    discard(shared)
    release(docs.sparkSession)

    @F.arrow_udf("array<struct<v1:bigint,v2:bigint,p:int,pos:int,h1:bigint,h2:bigint>>")
    def neighbourhood(packed: pa.Array, wanted: pa.Array) -> pa.Array:
        out = []
        for z, rows in zip(packed, wanted, strict=True):
            split = (_unpack(z.as_py()) or "").split("\n")
            made = []
            for r in rows.as_py():
                line = pc.utf8_lower(pa.scalar(split[r["pos"]])).as_py()
                made += [{"v1": a, "v2": b, "p": p, "pos": r["pos"], "h1": r["h1"], "h2": r["h2"]} for a, b, p in variants_of(line, r["stretches"])]
            out.append(made)
        kind = pa.list_(pa.struct([("v1", pa.int64()), ("v2", pa.int64()), ("p", pa.int32()), ("pos", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())]))
        return pa.array(out, kind)

    # Texts travel compressed.
    packed = keyed.select("_k", "_t", _packed(F.col("_x")).alias("_z"))
    emitted = gathered(packed.join(by_text, ["_k", "_t"]).dropDuplicates(["_k", "_t"])).select("_k", "_t", F.explode(neighbourhood("_z", "lines")).alias("v"))
    variants = materialize(emitted.select("_k", "_t", "v.*").select("v1", "v2", "p", "h1", "h2", _order().alias("ord")), "variants")
    discard(by_text)
    release(docs.sparkSession)
    same_place = variants.groupBy("v1", "v2", "p").agg(F.min("ord").alias("lead"))
    either = same_place.groupBy("v1", "v2").agg(F.min(F.when(F.col("p") < 0, F.col("lead"))).alias("whole"), F.min(F.when(F.col("p") >= 0, F.col("lead"))).alias("cut"))
    nearest = F.when(F.col("p") < 0, F.col("cut")).otherwise(F.least("lead", "whole"))
    near = variants.join(same_place, ["v1", "v2", "p"]).join(either, ["v1", "v2"]).where(nearest < F.col("ord")).select("h1", "h2").distinct().withColumn("near", F.lit(True))
    acted = materialize(gathered(firsts.join(near, ["h1", "h2"], "left").where("copies > 1 or near").select("h1", "h2", "first", "near")), "acted")
    discard(variants, firsts)
    release(docs.sparkSession)
    # One row a line on the right, so a line with very many occurrences can be split.
    places = lines.select("_k", "_t", "pos", "h1", "h2").join(acted, ["h1", "h2"]).where(F.coalesce("near", F.lit(False)) | (_order() != F.col("first")))
    gone = materialize(gathered(places.groupBy("_k", "_t").agg(F.collect_set("pos").alias("gone"), F.count_if(F.coalesce("near", F.lit(False))).cast("int").alias("n_near"))), "gone")
    discard(lines, acted)
    return gone


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", counts: str | None = None, min_words: int = MIN_WORDS, min_fuzzy: int = MIN_FUZZY) -> DataFrame:
    """``docs`` with the dropped lines taken out of the text.

    ``counts`` names one more column, a struct of n_lines, n_dropped and n_near; it must be a new name."""
    names = docs.columns
    if counts is not None:
        unused(docs, counts)
    # Written before the texts are shuffled, so that no shuffle of the search is held meanwhile.
    found = drops(docs, id_col=id_col, text_col=text_col, min_words=min_words, min_fuzzy=min_fuzzy)
    release(docs.sparkSession)
    # The other columns travel as one struct, so none of their names can clash.
    others = [c for c in names if c != text_col]
    packed = _keyed(docs, id_col, text_col, F.struct(*others).alias("_row"), _packed(F.col(text_col)).alias("_z"))

    @F.arrow_udf("struct<text:string,n:int>")
    def rest(z: pa.Array, gone: pa.Array) -> pa.Array:
        texts, n = [], []
        for v, g in zip(z, gone, strict=True):
            text, out = _unpack(v.as_py()), set(g.as_py() or ())
            split = [] if text is None else text.split("\n")
            n.append(len(split))
            texts.append(text if not out else "\n".join(x for i, x in enumerate(split) if i not in out))
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(n, pa.int32())], ["text", "n"])

    joined = gathered(packed.join(found, ["_k", "_t"], "left")).withColumn("_r", rest("_z", "gone"))
    told = F.struct(F.col("_r.n").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_dropped"), F.coalesce("n_near", F.lit(0)).alias("n_near"))
    extra = [] if counts is None else [told.alias(counts)]
    return joined.select(*[F.col("_r.text").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in names], *extra)
