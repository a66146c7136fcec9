"""Vector code compression: product codes whose codebooks are fitted by heap Lloyd, exactly.

A vector becomes integers, floor(1024 x), and is cut into ``PARTS`` equal parts. Each
part position has a codebook that starts as that part of the first ``ENTRIES`` vectors.
A round gives every part the nearest entry (ties to the lower index) and moves each
entry to the componentwise floor of its parts' mean; entries without parts stay.

Lloyd's rounds run over written blocks of vectors. A block keeps a heap for each entry of
each position: a part lies in the heap of its entry, keyed by its lower bound (distance of
the second nearest entry) minus its upper bound (distance of its own). A round does not
touch the keys; instead each entry has a cumulative drift, how far it and the
fastest other entry have moved together, and a part's key is its slack plus the drift at
the time it was pushed. Only parts whose key is no longer above the drift are popped and
measured against all entries anew; for the others the bounds prove that the nearest entry
is the same and unique. Bounds are floats rounded to the safe side, distances whole
numbers, so codes are those of plain Lloyd. Blocks send sums of the parts that changed
their entry only; what reaches the driver is one sum for each codebook number.

Defined results: rows whose vector is null or has null or non-finite components are
dropped; vectors are ordered by id, null ids last, then by components, so repeated rows
count each; fewer vectors than ``ENTRIES`` give a smaller codebook; equal vectors get
equal codes; vectors of no components get code zeros and no error; an empty table gives
no rows; other columns pass through, and a column named as an output is an error. Vectors
of unlike lengths, of a length that ``PARTS`` does not divide, or with components of
2^18 and more are an error that names them. Longer vectors need no more than a block's
memory (``BLOCK`` values).
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.sqlx import fresh, unused
from tidewell.session import discard, materialize

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Components of a block of vectors at most (a longer vector is a block of its own), and its vectors at most.
BLOCK = 1 << 19
MOST = 1 << 14
#: Components must be smaller than this, so that sums of squares are exact in 64 bits.
BOUND = 1 << 18
_SAFE = 1e-9


@dataclass
class Codebooks:
    """Entries of each position, with how far each has drifted since the first round."""

    entries: list[np.ndarray]
    drift: list[np.ndarray]
    n: int = 0

    def moved(self, after: list[np.ndarray]) -> Codebooks:
        """The next round's codebooks: a heap's drift grows by its entry's move and the largest other move."""
        drift = []
        for old, new, before in zip(self.entries, after, self.drift, strict=True):
            move = np.sqrt(((new - old).astype(np.float64) ** 2).sum(1))
            other = np.zeros(len(move))
            if len(move) > 1:
                top = np.argsort(move)[-2:]
                other[:] = move[top[1]]
                other[top[1]] = move[top[0]]
            drift.append(before + (move + other) * (1 + _SAFE))
        return Codebooks(after, drift, self.n + 1)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for book in self.entries for v in book.ravel().tolist()).encode()).hexdigest()


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all entries."""
    x, c = x.astype(np.float64), book.astype(np.float64)
    most = max(float(np.abs(x).max(initial=0)), float(np.abs(c).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < 1 << 53:  # products by the processor's matrix unit are whole numbers then
        return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]
    whole = [((x.astype(np.int64) - row) ** 2).sum(1) for row in book.astype(np.int64)]
    return np.stack(whole, 1)


def _popped(heaps: list[list[tuple[float, int]]], drift: np.ndarray) -> tuple[list[int], list[int]]:
    """Parts whose bounds the drift has violated, and the entries they leave."""
    rows, left = [], []
    for entry, heap in enumerate(heaps):
        limit = drift[entry]
        while heap and heap[0][0] <= limit:
            rows.append(heapq.heappop(heap)[1])
            left.append(entry)
    return rows, left


def _scanned(x: np.ndarray, rows: np.ndarray, book: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and heap key of the given parts, measured against every entry."""
    own, key = np.empty(len(rows), np.int64), np.empty(len(rows))
    for at in range(0, len(rows), 2048):
        some = slice(at, at + 2048)
        d = squares(x[rows[some]], book)
        best = d.argmin(1)  # the first of equal ones
        nearest = d[np.arange(len(d)), best]
        if len(book) > 1:
            second = np.partition(d, 1, axis=1)[:, 1]
            slack = np.sqrt(second.astype(np.float64)) * (1 - _SAFE) - np.sqrt(nearest.astype(np.float64)) * (1 + _SAFE)
        else:
            slack = np.full(len(d), np.inf)
        own[some], key[some] = best, slack + drift[best]
    return own, np.nextafter(key.astype(np.float32), np.float32(-np.inf)).astype(np.float64)


def _state(heaps: list[list[list[tuple[float, int]]]]) -> bytes:
    """Heaps of all positions as bytes: sizes, then keys and rows entry by entry."""
    out = []
    for book in heaps:
        flat = [pair for heap in book for pair in heap]
        out += [np.array([len(heap) for heap in book], np.uint32).tobytes(), np.array([k for k, _ in flat], np.float32).tobytes(), np.array([r for _, r in flat], np.uint16).tobytes()]
    return b"".join(out)


def _heaps(state: bytes, entries: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sizes, keys and rows of each position."""
    at, step = 0, 4 * entries + 6 * n
    while at < len(state):
        sizes = np.frombuffer(state, np.uint32, entries, at)
        yield sizes, np.frombuffer(state, np.float32, n, at + 4 * entries), np.frombuffer(state, np.uint16, n, at + 4 * (entries + n))
        at += step


def advance(x: np.ndarray, state: bytes | None, books: Codebooks, parts: int) -> tuple[bytes, list[tuple[int, int, int, int]]]:
    """A block's next heaps, and what its parts' moves add to each (part, entry, place); place -1 counts parts."""
    width, after, changes = x.shape[1] // parts, [], []
    before = list(_heaps(state, len(books.entries[0]), len(x))) if state is not None else [None] * parts
    for p, (book, drift) in enumerate(zip(books.entries, books.drift, strict=True)):
        part = x[:, p * width : (p + 1) * width]
        if before[p] is None:
            heaps = [[] for _ in range(len(book))]
            rows, left = np.arange(len(x)), np.full(len(x), -1)
        else:
            sizes, keys, members = before[p]
            pairs, ends = list(zip(keys.tolist(), members.tolist(), strict=True)), np.cumsum(sizes).tolist()
            heaps = [pairs[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            rows, left = (np.array(v, np.int64) for v in _popped(heaps, drift))
        own, key = _scanned(part, rows, book, drift)
        for k, r, e in zip(key.tolist(), rows.tolist(), own.tolist(), strict=True):
            if before[p] is None:
                heaps[e].append((k, r))
            else:
                heapq.heappush(heaps[e], (k, r))
        if before[p] is None:
            for heap in heaps:
                heapq.heapify(heap)
        after.append(heaps)
        new = own != left
        total, count = np.zeros((len(book) + 1, width), np.int64), np.zeros(len(book) + 1, np.int64)
        np.add.at(total, own[new], part[rows[new]].astype(np.int64))
        np.add.at(count, own[new], 1)
        gone = new & (left >= 0)
        np.subtract.at(total, left[gone], part[rows[gone]].astype(np.int64))
        np.subtract.at(count, left[gone], 1)
        for e in np.flatnonzero((count != 0) | (total != 0).any(1)).tolist():
            changes.append((p, e, -1, int(count[e])))
            changes += [(p, e, j, v) for j, v in enumerate(total[e].tolist()) if v]
    return _state(after), changes


def _matrix(buffer: bytes, rows: int, kind: str) -> np.ndarray:
    return np.frombuffer(buffer, kind).reshape(rows, -1)


def _kind(most: int) -> str:
    """The smallest whole numbers that hold every component."""
    return "int16" if most < 1 << 15 else "int32"


def blocks(kept: DataFrame, ints: str, width: int, kind: str) -> DataFrame:
    """(n, x, rows): vectors as one matrix, and all other columns of their rows."""
    others = [c for c in kept.columns if c != ints]
    most = max(1, min(MOST, BLOCK // max(1, width)))
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("x", T.BinaryType()), T.StructField("rows", T.ArrayType(kept.select(others).schema))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            x = table[ints].combine_chunks()
            x = (x.flatten() if len(x) else pa.array([], pa.int32())).to_numpy(zero_copy_only=False).astype(kind)
            fields = [table[c].combine_chunks() for c in others]
            rows = pa.StructArray.from_arrays([f.chunk(0) if isinstance(f, pa.ChunkedArray) else f for f in fields], others)
            return pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)], ["n", "x", "rows"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, most - n)
                held.append(some)
                n, at = n + some.num_rows, at + some.num_rows
                if n == most:
                    yield block()
                    held, n = [], 0
        if n:
            yield block()

    return kept.mapInArrow(pack, schema)


def fit(table: DataFrame, first: list[np.ndarray], *, kind: str, parts: int = PARTS, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """The final codebooks, and the written blocks with a column ``state`` of heaps assigned to them."""
    spark = table.sparkSession
    books = Codebooks(first, [np.zeros(len(b)) for b in first])
    total = [np.zeros(b.shape, object) for b in first]
    count = [np.zeros(len(b), object) for b in first]
    now, old = table.withColumn("state", F.lit(None).cast("binary")), None
    for _ in range(rounds + 1):
        shared = spark.sparkContext.broadcast(books)  # ``ENTRIES`` vectors

        @F.arrow_udf("struct<state: binary, changes: array<struct<part: int, entry: int, place: int, total: bigint>>>")
        def step(n: pa.Array, x: pa.Array, state: pa.Array) -> pa.Array:
            states, changes = [], []
            for rows, matrix, heaps in zip(n.to_pylist(), x.to_pylist(), state.to_pylist(), strict=True):
                after, change = advance(_matrix(matrix, rows, kind), heaps, shared.value, parts)
                states.append(after)
                changes.append([dict(zip(("part", "entry", "place", "total"), c, strict=True)) for c in change])
            fields = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("total", pa.int64())]))
            return pa.StructArray.from_arrays([pa.array(states, pa.binary()), pa.array(changes, fields)], ["state", "changes"])

        new = materialize(now.withColumn("done", step("n", "x", "state")).select("n", "x", "rows", "done.state", "done.changes"), "heaps")
        if old is not None:
            discard(old)
        now, old = new.drop("changes"), new
        if books.n == rounds:
            return now, books
        # Two numbers for each number of the codebooks at most, however many vectors there are.
        for r in new.select(F.inline("changes")).groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect():
            if r["place"] < 0:
                count[r["part"]][r["entry"]] += r["total"]
            else:
                total[r["part"]][r["entry"], r["place"]] += r["total"]
        after = []
        for book, t, c in zip(books.entries, total, count, strict=True):
            moved = book.copy()
            for e in np.flatnonzero(c > 0):
                moved[e] = [int(v) // int(c[e]) for v in t[e]]
            after.append(moved)
        books = books.moved(after)
    raise AssertionError("unreachable")


def coded(table: DataFrame, books: Codebooks, *, kind: str, parts: int = PARTS) -> DataFrame:
    """The rows of fitted blocks with ``code`` and ``error``: exact distances to the entries whose heaps hold the parts."""
    shared = table.sparkSession.sparkContext.broadcast(books)  # ``ENTRIES`` vectors

    @F.arrow_udf("array<struct<code: string, error: bigint>>")
    def read(n: pa.Array, x: pa.Array, state: pa.Array) -> pa.Array:
        out, entries = [], len(shared.value.entries[0])
        for rows, matrix, heaps in zip(n.to_pylist(), x.to_pylist(), state.to_pylist(), strict=True):
            m = _matrix(matrix, rows, kind).astype(np.int64)
            codes, error, width = np.zeros((rows, parts), np.uint8), np.zeros(rows, np.int64), m.shape[1] // parts
            for p, (sizes, _, members) in enumerate(_heaps(heaps, entries, rows)):
                own = np.zeros(rows, np.int64)
                own[members] = np.repeat(np.arange(entries), sizes)
                codes[:, p] = own
                error += ((m[:, p * width : (p + 1) * width] - shared.value.entries[p][own]) ** 2).sum(1)
            hexed = codes.tobytes().hex()
            out.append([{"code": hexed[2 * parts * i : 2 * parts * (i + 1)], "error": e} for i, e in enumerate(error.tolist())])
        return pa.array(out, pa.list_(pa.struct([("code", pa.string()), ("error", pa.int64())])))

    return table.select(F.inline(F.arrays_zip("rows", read("n", "x", "state").alias("coded")))).select("rows.*", F.col("coded.code").alias("code"), F.col("coded.error").alias("error"))


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Every kept row without its vector, with code, error, label_error and codebooks_sha256."""
    out = ("code", "error", "label_error", "codebooks_sha256")
    for name in out:
        unused(vectors, name)
    if entries > ENTRIES:
        raise ValueError("a part's code has two hex digits")
    ints = fresh(vectors, "_ints")
    finite = F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = vectors.where(F.col(vector_col).isNotNull() & finite)
    size, top = F.size(vector_col), F.coalesce(F.array_max(F.transform(vector_col, F.abs)), F.lit(0.0))
    seen = kept.agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("low"), F.max(size).alias("high"), F.max(top).cast("double").alias("top")).first()
    if not seen["n"]:
        return kept.drop(vector_col).withColumns({"code": F.lit(""), "error": F.lit(0).cast("bigint"), "label_error": F.lit(0).cast("bigint"), "codebooks_sha256": F.lit("")})
    if seen["low"] != seen["high"] or seen["low"] % parts:
        raise ValueError(f"vectors have {seen['low']} to {seen['high']} components; all need the same number, a multiple of {parts}")
    if seen["top"] >= BOUND:
        raise ValueError(f"a component is {seen['top']}; they must be below {BOUND}")
    width, kind = seen["low"], _kind(int(seen["top"] * SCALE) + 1)
    whole = kept.withColumn(ints, F.transform(vector_col, lambda v: F.floor(v * F.lit(SCALE).cast("double")).cast("int"))).drop(vector_col)
    heads = whole.orderBy(F.col(id_col).asc_nulls_last(), F.col(ints)).select(ints).limit(entries).collect()
    heads = np.array([r[0] for r in heads], np.int64).reshape(len(heads), width)
    first = [heads[:, p * width // parts : (p + 1) * width // parts].copy() for p in range(parts)]
    table, books = fit(blocks(whole, ints, width, kind), first, kind=kind, parts=parts, rounds=rounds)
    rows = materialize(coded(table, books, kind=kind, parts=parts), "codes")
    of = fresh(rows, "_of")
    totals = materialize(rows.groupBy(F.col(label_col).alias(of)).agg(F.sum("error").alias("label_error")), "labels")
    # Spark sends the written totals to all tasks where they are small, and else splits a frequent label's partition.
    joined = rows.join(totals, F.col(label_col).eqNullSafe(F.col(of)), "left")
    return joined.select(*rows.columns, "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
