"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

The vocabulary is a public model file, read on the driver and broadcast (its
size is fixed). A text is cut into chunks, a run of blanks and what follows it,
because no piece has a blank inside. Candidate merges of a chunk leave its agenda
best score first, leftmost first, and a candidate is skipped when a hash of (seed,
document, place of the chunk in the text, place in the chunk, pair) falls below
``dropout``: the same everywhere, on any cluster, without a generator. Every
occurrence of a word draws anew, and a new ``seed`` gives a new epoch. The agendas of
all chunks of a block run at once, a merge of each a round. Characters outside the
vocabulary, and the blank mark itself, become byte pieces, so that decoding gives
back every text exactly.

Defined results: null encodes to null and decodes to null; the empty text to no
pieces; rows are encoded one by one, so ties and repeated rows agree (equal text
and equal id give equal pieces); other columns pass through.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.bytestext import blocks, mix
from tidewell.llm.sqlx import unused

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
BLOCK = 1 << 18
#: Chunks of more symbols are encoded with a heap, one by one.
LONG = 64
_MARK = "▁"
_NONE = np.iinfo(np.int64).max
SLOT_BITS = 19


@dataclass
class Vocabulary:
    """Pieces of a model: id of each character, merges by pair, bytes of each piece."""

    pieces: list[str]
    scores: list[float]
    first_byte: int
    normal: list[bool]
    char_id: np.ndarray = field(default=None, repr=False)
    keys: np.ndarray = field(default=None, repr=False)
    ranks: np.ndarray = field(default=None, repr=False)
    merged: np.ndarray = field(default=None, repr=False)
    pool: np.ndarray = field(default=None, repr=False)
    at: np.ndarray = field(default=None, repr=False)
    slots: np.ndarray = field(default=None, repr=False)
    crowded: np.ndarray = field(default=None, repr=False)

    @classmethod
    def read(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.vocab_size())
        normal = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in ids]
        return cls([sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids], sp.piece_to_id("<0x00>"), normal)

    def ready(self) -> Vocabulary:
        """Derived tables, made once where they are used."""
        if self.char_id is not None:
            return self
        of = {p: i for i, (p, n) in enumerate(zip(self.pieces, self.normal, strict=True)) if n}
        chars = np.full(0x110000, -1, np.int32)
        for p, i in of.items():
            if len(p) == 1:
                chars[ord(p)] = i
        # In the stream the mark stands as a blank; a mark in the text itself is spelled in bytes.
        chars[0x20], chars[ord(_MARK)] = chars[ord(_MARK)], -1
        order = sorted(of.values(), key=lambda i: (-self.scores[i], i))
        rank = {i: r for r, i in enumerate(order)}
        rows = [(of[p[:k]] * len(self.pieces) + of[p[k:]], rank[i], i) for p, i in of.items() for k in range(1, len(p)) if p[:k] in of and p[k:] in of]
        table = np.array(sorted(rows), np.int64)
        self.keys, self.ranks, self.merged = table[:, 0].copy(), table[:, 1].copy(), table[:, 2].astype(np.int32)
        spelled = [bytes([i - self.first_byte]) if self.first_byte <= i < self.first_byte + 256 else p.replace(_MARK, " ").encode() if n else b"" for i, (p, n) in enumerate(zip(self.pieces, self.normal, strict=True))]
        self.pool = np.frombuffer(b"".join(spelled), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(b) for b in spelled])])
        # A pair's first guess is one slot away; only pairs of crowded slots are searched for.
        slot = self._slot(self.keys)
        self.slots, self.crowded = np.zeros(1 << SLOT_BITS, np.int64), np.bincount(slot, minlength=1 << SLOT_BITS) > 1
        self.slots[slot] = np.arange(len(self.keys))
        self.char_id = chars
        return self

    def __getstate__(self):
        return {"pieces": self.pieces, "scores": self.scores, "first_byte": self.first_byte, "normal": self.normal}

    def __setstate__(self, state):
        self.__init__(**state)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair's merge; rank _NONE where there is none."""
        key = left.astype(np.int64) * len(self.pieces) + right
        slot = self._slot(key)
        i = self.slots[slot]
        hit = self.keys[i] == key
        more = np.flatnonzero(self.crowded[slot] & ~hit)
        if len(more):
            i[more] = np.minimum(np.searchsorted(self.keys, key[more]), len(self.keys) - 1)
            hit[more] = self.keys[i[more]] == key[more]
        hit &= (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[i], _NONE), np.where(hit, self.merged[i], -1)


def _skipped(chunk: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the keyed hash skips a candidate."""
    if dropout <= 0:
        return np.zeros(len(place), bool)
    pair = left.astype(np.uint64) * np.uint64(1 << 20) + right.astype(np.uint64)
    return mix(chunk ^ mix(pair + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) < np.uint64(int(min(dropout, 1 - 2**-53) * 2**64))


def agenda(v: Vocabulary, ids: np.ndarray, chunk: int, dropout: float) -> list[int]:
    """One chunk by a heap of candidates: the rule itself, and the way for long chunks."""
    sym, n = ids.tolist(), len(ids)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int, int, int]] = []
    code = np.array([chunk], np.uint64)

    def offer(i: int) -> None:
        j = after[i]
        if 0 <= i and j < n:
            a, b = np.array([sym[i]]), np.array([sym[j]])
            rank, made = v.lookup(a, b)
            if rank[0] != _NONE and not _skipped(code, np.array([i]), a, b, dropout)[0]:
                heapq.heappush(heap, (int(rank[0]), i, sym[i], sym[j], int(made[0])))

    ranks, made = v.lookup(ids[:-1], ids[1:]) if n > 1 else (np.zeros(0, np.int64), None)
    on = np.flatnonzero(ranks != _NONE)
    on = on[~_skipped(code, on, ids[on], ids[on + 1], dropout)] if len(on) else on
    heap = [(int(ranks[i]), int(i), sym[i], sym[i + 1], int(made[i])) for i in on]
    heapq.heapify(heap)
    while heap:
        _, i, a, b, piece = heapq.heappop(heap)
        j = after[i] if i < n else n
        if not alive[i] or j >= n or sym[i] != a or sym[j] != b:
            continue
        sym[i], alive[j], after[i] = piece, False, after[j]
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [s for s, a in zip(sym, alive, strict=True) if a]


def _offers(v: Vocabulary, sym: np.ndarray, owner: np.ndarray, place: np.ndarray, chunk: np.ndarray, dropout: float, at: np.ndarray) -> np.ndarray:
    """The turn of the merge of each symbol ``at`` with the next one, best first; _NONE where there is none or it is skipped."""
    out = np.full(len(at), _NONE)
    inside = np.flatnonzero(owner[at] == owner[at + 1])
    i = at[inside]
    rank, _ = v.lookup(sym[i], sym[i + 1])
    ok = rank != _NONE
    inside, i, rank = inside[ok], i[ok], rank[ok]
    if dropout > 0:
        go = ~_skipped(chunk[owner[i]], place[i], sym[i], sym[i + 1], dropout)
        inside, i, rank = inside[go], i[go], rank[go]
    # Ranks are below 2^20 and a chunk has at most LONG symbols: one number orders by rank, then place.
    out[inside] = rank * (LONG + 1) + place[i]
    return out


def _segment(v: Vocabulary, sym: np.ndarray, size: np.ndarray, chunk: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of many chunks at once: each round makes the best merge of every chunk. (flat pieces, sizes)."""
    owner = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(sym)) - np.repeat(np.cumsum(size) - size, size)
    done_sym, done_owner, done_place = [], [], []
    long = size > LONG
    if long.any():
        start = np.cumsum(size) - size
        for c in np.flatnonzero(long):
            out = agenda(v, sym[start[c] : start[c] + size[c]], int(chunk[c]), dropout)
            done_sym.append(np.array(out, np.int32))
            done_owner.append(np.full(len(out), c))
            done_place.append(np.arange(len(out)))
        rest = ~long[owner]
        sym, owner, place = sym[rest], owner[rest], place[rest]
    sym = sym.copy()
    order = _offers(v, sym, owner, place, chunk, dropout, np.arange(max(0, len(sym) - 1)))
    order = np.append(order, np.full(len(sym) - len(order), _NONE))
    while len(sym):
        head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        width = np.diff(np.append(head, len(sym)))
        low = np.minimum.reduceat(order, head)
        going = low != _NONE
        live = np.repeat(going, width)
        if not going.all():
            done_sym.append(sym[~live])
            done_owner.append(owner[~live])
            done_place.append(place[~live])
            if not going.any():
                break
        best = np.flatnonzero((order == np.repeat(low, width)) & live)
        _, made = v.lookup(sym[best], sym[best + 1])
        sym[best] = made
        live[best + 1] = False
        at = np.cumsum(live) - 1
        sym, owner, place, order = sym[live], owner[live], place[live], order[live]
        # Only the pairs of a merged symbol with its neighbours are new.
        new = at[best]
        fresh = np.concatenate([new, new[new > 0] - 1])
        order[fresh] = _NONE
        fresh = fresh[fresh + 1 < len(sym)]
        order[fresh] = _offers(v, sym, owner, place, chunk, dropout, fresh)
    if not done_sym:
        return np.zeros(0, np.int32), np.zeros(len(size), np.int64)
    flat, own, at = np.concatenate(done_sym), np.concatenate(done_owner), np.concatenate(done_place)
    order = np.argsort(own * (1 << 32) + at, kind="stable")
    return flat[order].astype(np.int32), np.bincount(own, minlength=len(size))


def _stretch(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start .. start + size - 1 of every stretch, one after another."""
    total = int(size.sum())
    return np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def encode_block(v: Vocabulary, data: np.ndarray, offsets: np.ndarray, salt: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """(pieces of all texts, pieces of each text). ``salt`` is a hash of seed and document."""
    rows = len(offsets) - 1
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    text = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = lead + np.arange(rows + 1)
    full = lead[1:] > lead[:-1]
    stream = np.zeros(len(text) + rows, np.uint32)
    body = np.ones(len(stream), bool)
    body[first[:-1]] = False
    stream[body] = text
    stream[first[:-1]] = 0x20
    if not full.all():  # the empty text has no pieces, not one blank
        there = np.ones(len(stream), bool)
        there[first[:-1][~full]] = False
        first = np.concatenate([[0], np.cumsum(there)])[first]
        stream = stream[there]
    if not len(stream):
        return np.zeros(0, np.int32), np.zeros(rows, np.int64)
    blank = stream == 0x20
    opens = blank.copy()
    opens[1:] &= ~blank[:-1]
    opens[first[:-1][full]] = True
    start = np.flatnonzero(opens)
    end = np.append(start[1:], len(stream))
    chunk_of_row = np.searchsorted(start, first)
    doc = np.repeat(np.arange(rows), np.diff(chunk_of_row))
    key = mix(salt[doc] + (start - first[doc]).astype(np.uint64))
    ids, count = _segment(v, _with_unknown(v, stream), end - start, key, dropout)
    ids, count = _spell(v, ids, count)
    return ids, np.diff(np.concatenate([[0], np.cumsum(count)])[chunk_of_row])


def _with_unknown(v: Vocabulary, code: np.ndarray) -> np.ndarray:
    """Piece of each character; -2 - code point where there is none."""
    ids = v.char_id[code]
    return np.where(ids >= 0, ids, -2 - code.astype(np.int32))


def _spell(v: Vocabulary, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace characters without a piece by their byte pieces."""
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return ids, count
    spelled = [chr(-2 - int(c)).encode("utf-8") for c in ids[odd]]
    width = np.ones(len(ids), np.int64)
    width[odd] = [len(b) for b in spelled]
    out = np.repeat(ids, width)
    first = (np.cumsum(width) - width)[odd]
    out[_stretch(first, width[odd])] = np.frombuffer(b"".join(spelled), np.uint8).astype(np.int32) + v.first_byte
    owner = np.repeat(np.arange(len(count)), count)
    return out, np.bincount(owner, weights=width, minlength=len(count)).astype(np.int64)


def decode_rows(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Texts of rows of pieces."""
    size = (v.at[1:] - v.at[:-1])[ids]
    flat = v.pool[_stretch(v.at[ids], size)].tobytes()
    ends = np.concatenate([[0], np.cumsum(size)])[offsets]
    return [flat[a + 1 : b].decode("utf-8") if b > a else "" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def encode(docs: DataFrame, *, model: str = MODEL, text_col: str = "text", id_col: str = "doc_id", dropout: float = DROPOUT, seed: int = 0, name: str = "pieces") -> DataFrame:
    """``docs`` with the ids of each text's pieces in a new column; a column of that name is an error."""
    unused(docs, name)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(model))

    @F.arrow_udf("array<int>")
    def pieces(texts: pa.Array, document: pa.Array) -> pa.Array:
        v = shared.value.ready()
        salt = mix(np.asarray(document, np.int64).view(np.uint64) ^ mix(np.array([seed & (1 << 64) - 1], np.uint64)))
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at, rows, data, offsets in blocks(texts, BLOCK):
            got, n = encode_block(v, data, offsets, salt[at : at + rows], dropout)
            ids.append(got)
            sizes.append(n)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        none = np.asarray(texts.is_null())
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)), mask=pa.array(none) if none.any() else None)

    # Spark evaluates a deterministic function anew in every Python function that reads it, as ``decoded``
    # does; the mark forbids that, so that a text is encoded once. Its values depend on the row alone.
    once = pieces.asNondeterministic()
    return docs.withColumn(name, once(F.col(text_col), F.xxhash64(F.col(id_col))))


def decoded(spark_df: DataFrame, column: Column, *, model: str = MODEL) -> Column:
    """The text of a column of piece ids."""
    shared = spark_df.sparkSession.sparkContext.broadcast(Vocabulary.read(model))

    @F.arrow_udf("string")
    def text(rows: pa.Array) -> pa.Array:
        v = shared.value.ready()
        out: list[str | None] = []
        for at in range(0, len(rows), 256):
            part = rows.slice(at, 256)
            sizes = [0 if x is None else x for x in part.value_lengths().to_pylist()]
            ids = np.asarray(part.flatten(), np.int64)
            got = decode_rows(v, ids, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
            out += [None if gone else t for t, gone in zip(got, part.is_null().to_pylist(), strict=True)]
        return pa.array(out, pa.string())

    return text(column)
