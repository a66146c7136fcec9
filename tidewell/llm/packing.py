"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands.

Texts are cut into tokens and an end mark; only documents longer than a sequence are cut,
into pieces of a sequence's length after a first piece that may be shorter. Full pieces
are sequences of their own. All others are dealt to islands of about ``ISLAND`` pieces, by
hash. An island keeps a population of packings of its pieces. A child takes whole
well-filled bins of one parent, drops the other parent's bins that hold one of their
pieces (so that no piece is there twice), and puts the displaced pieces back by best fit,
longest first; the worst packings give way. After each epoch an island sends the
lengths of its best packing's fullest bins to the next island of a ring, which builds these
bins from pieces of its own and injects them. Islands are rows of a written table, one
table an epoch, so their work is spread, bounded by ``ISLAND`` and survives the loss of
executors. The pieces of loosely filled sequences then go to new, far fewer islands, until
one island holds them or they no longer halve.

Defined results: null and empty texts are one piece, the end mark; every row is a
document of its own, so repeated rows and null ids are packed each; equal lengths are
ordered by row and piece; an empty table gives no rows; long texts are cut, nothing is
dropped. Only the named columns are read, so others may have any name. Ids are those of
the tokenizer file. Draws are seeded by ``SEED``, level, epoch and island.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.session import discard, materialize

CAPACITY = 1024
END = 2
TOKENIZER = "byte_bpe_50k.json"
#: Pieces of an island, packings of its population, children an epoch, epochs.
ISLAND = 8192
POPULATION = 6
CHILDREN = 24
EPOCHS = 3
#: Bins that an island sends on after an epoch.
ELITE = 64
#: Sequences filled less than this are packed again across islands.
LOOSE = 0.99
SEED = 13


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest in order from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids of the tokenizer file, as an array.

    Merges run in the order of ids and every token of the file is what its own text encodes to
    (a test holds both), so a rank encoder over the same vocabulary gives the same ids several times
    faster; texts with the name of an added token go through the file's own tokenizer."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added, byte_of = [t["content"] for t in spec["added_tokens"]], _byte_of()
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(path)

    def encode(text: str) -> np.ndarray:
        if any(name in text for name in added):
            return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode


def cut(ids: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all but the first are full."""
    n = len(ids)
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(row, doc, piece, start, length, ids_crc32) of every document, with the ``ids`` themselves where asked for.

    ``row`` is fixed once the table is written."""
    path = path or tokenizer_path()
    kind = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)

    @F.arrow_udf("array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint" + ", ids: array<int>" * with_ids + ">>")
    def tokenized(texts: pa.Array) -> pa.Array:
        encode, out = encoder(path), []
        for text in texts:
            ids = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
            found = []
            for k, (start, length) in enumerate(cut(ids, capacity)):
                own = ids[start : start + length]
                found.append({"piece": k, "start": start, "length": length, "ids_crc32": zlib.crc32(own.tobytes())} | ({"ids": own.astype(np.int32)} if with_ids else {}))
            out.append(found)
        return pa.array(out, pa.list_(kind))

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc"), tokenized(F.col(text_col)).alias("cut"))
    return numbered.select("row", "doc", F.inline("cut"))


def best_fit(lengths: list[int], order: list[int], bins: np.ndarray, free: list[int], capacity: int) -> None:
    """Put pieces into the fullest bin that takes them; ``bins`` and ``free`` change, new bins go to the end."""
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit f is set where a bin has f places free
    for b, f in enumerate(free):
        if f:
            by_free[f].append(b)
            some |= 1 << f
    for i in order:
        n = lengths[i]
        fits = some >> n
        if fits:
            f = n + (fits & -fits).bit_length() - 1
            held = by_free[f]
            b = held.pop()
            if not held:
                some ^= 1 << f
        else:
            f, b = capacity, len(free)
            free.append(capacity)
        bins[i] = b
        free[b] = f = f - n
        if f:
            by_free[f].append(b)
            some |= 1 << f


def _kept(bins: np.ndarray, keep: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Bins renumbered without those dropped (their pieces get -1), the free places of the rest, and the pieces left over."""
    number = np.where(keep, np.cumsum(keep) - 1, -1)
    after = np.where(bins >= 0, number[bins], -1)
    loads = np.bincount(after[after >= 0], weights=lengths[after >= 0], minlength=int(keep.sum())).astype(np.int64)
    return after, (capacity - loads).tolist(), np.flatnonzero(after < 0)


class Island:
    """Packings of one island's pieces, which come longest first."""

    def __init__(self, lengths: np.ndarray, capacity: int, rng: np.random.Generator):
        self.lengths, self.capacity, self.rng = lengths.astype(np.int64), capacity, rng
        self.as_list = self.lengths.tolist()
        self.least = -(-int(self.lengths.sum()) // capacity)

    def loads(self, bins: np.ndarray) -> np.ndarray:
        return np.bincount(bins, weights=self.lengths).astype(np.int64)

    def cost(self, bins: np.ndarray) -> tuple[int, int]:
        """Fewer bins are better; of as many, those with more in full bins."""
        loads = self.loads(bins)
        return len(loads), -int((loads * loads).sum())

    def fresh(self, noise: float) -> np.ndarray:
        """Best fit of the pieces, longest first, with lengths blurred by ``noise``."""
        order = np.argsort(-self.lengths * (1 + noise * self.rng.random(len(self.lengths))), kind="stable")
        bins = np.full(len(self.lengths), -1)
        best_fit(self.as_list, order.tolist(), bins, [], self.capacity)
        return bins

    def injected(self, bins: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """``bins`` with the groups (a number for each piece, or -1) put in whole: bins with one of their
        pieces go, and displaced pieces are put back by best fit."""
        inside = groups >= 0
        hit = np.zeros(int(bins.max(initial=-1)) + 1, bool)
        hit[bins[inside]] = True
        bare = np.where(inside, -1, bins)
        after, free, _ = _kept(bare, ~hit, self.lengths, self.capacity)
        numbers, own = np.unique(groups[inside], return_inverse=True)
        after[inside] = own + len(free)
        free += (self.capacity - np.bincount(own, weights=self.lengths[inside], minlength=len(numbers)).astype(np.int64)).tolist()
        best_fit(self.as_list, np.flatnonzero(after < 0).tolist(), after, free, self.capacity)
        return after

    def crossed(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """A child of ``one`` with some of the well-filled bins of ``other``."""
        loads = self.loads(other)
        chosen = (loads >= np.median(loads)) & (self.rng.random(len(loads)) < self.rng.uniform(0.05, 0.6))
        return self.injected(one, np.where(chosen[other], other, -1))

    def shaken(self, bins: np.ndarray) -> np.ndarray:
        """The emptiest bins and a few others are emptied and their pieces put back by best fit."""
        loads = self.loads(bins)
        drop = (loads <= np.quantile(loads, 0.02)) | (self.rng.random(len(loads)) < 0.02)
        drop |= loads == loads.min()
        after, free, loose = _kept(bins, ~drop, self.lengths, self.capacity)
        best_fit(self.as_list, loose.tolist(), after, free, self.capacity)
        return after

    def settled(self, bins: np.ndarray, patterns: list[list[int]]) -> np.ndarray:
        """``bins`` with migrants: bins of the given lengths, as far as own pieces of these lengths are left."""
        at, groups = {}, np.full(len(self.lengths), -1)
        start = {n: i for i, n in reversed(list(enumerate(self.as_list)))}
        for k, pattern in enumerate(patterns):
            took = []
            for n in pattern:
                i = at.get(n, start.get(n))
                if i is None or i >= len(self.as_list) or self.as_list[i] != n:
                    break
                at[n] = i + 1
                took.append(i)
            if len(took) == len(pattern):
                groups[took] = k
        return self.injected(bins, groups) if (groups >= 0).any() else bins

    def epoch(self, population: list[np.ndarray], migrants: list[list[int]], size: int, children: int) -> list[np.ndarray]:
        """The next population, best first."""
        if not population:
            population = [self.fresh(0.0)] + [self.fresh(x) for x in np.linspace(0.05, 0.6, size - 1)]
        ranked = sorted(((self.cost(b), k, b) for k, b in enumerate(population)), key=lambda x: x[:2])

        def admit(bins: np.ndarray, k: int) -> None:
            c = self.cost(bins)
            if c < ranked[-1][0] and all(c != r[0] for r in ranked):
                ranked[-1] = (c, k, bins)
                ranked.sort(key=lambda x: x[:2])

        if migrants:
            admit(self.settled(ranked[0][2], migrants), size)
        for k in range(children):
            if ranked[0][0][0] == self.least:
                break
            one, other = self.rng.integers(0, len(ranked), 2)
            child = self.crossed(ranked[min(one, other)][2], ranked[max(one, other)][2]) if one != other else ranked[one][2]
            admit(self.shaken(child), size + 1 + k)
        return [b for _, _, b in ranked]

    def elite(self, bins: np.ndarray, most: int) -> list[list[int]]:
        """Lengths of the fullest bins, those of the fewest pieces first."""
        loads, counts = self.loads(bins), np.bincount(bins)
        best = np.lexsort((counts, -loads))[:most]
        out = {int(b): [] for b in best}
        for i in np.flatnonzero(np.isin(bins, best)).tolist():
            out[int(bins[i])].append(self.as_list[i])
        return list(out.values())


def _packed(population: list[np.ndarray]) -> bytes:
    return np.stack(population).astype(np.uint16).tobytes()


def _evolver(level: int, epoch: int, capacity: int, size: int, children: int) -> Callable[..., Column]:
    @F.arrow_udf("struct<population: binary, elite: array<array<int>>, sequences: int>")
    def evolve(islands: pa.Array, lengths: pa.Array, populations: pa.Array, migrants: pa.Array) -> pa.Array:
        out = []
        for island, own, population, come in zip(islands.to_pylist(), lengths, populations.to_pylist(), migrants.to_pylist(), strict=True):
            own = own.values.to_numpy(zero_copy_only=False)
            place = Island(own, capacity, np.random.default_rng([SEED, level, epoch, island]))
            known = [] if population is None else [b.astype(np.int64) for b in np.frombuffer(population, np.uint16).reshape(-1, len(own))]
            after = place.epoch(known, come or [], size, children)
            out.append({"population": _packed(after), "elite": place.elite(after[0], ELITE), "sequences": int(after[0].max()) + 1})
        kind = pa.struct([("population", pa.binary()), ("elite", pa.list_(pa.list_(pa.int32()))), ("sequences", pa.int32())])
        return pa.array(out, kind)

    return evolve


def _placer(capacity: int) -> Callable[..., Column]:
    @F.arrow_udf("array<struct<bin: int, offset: bigint, load: bigint>>")
    def place(lengths: pa.Array, populations: pa.Array) -> pa.Array:
        out = []
        for own, population in zip(lengths, populations.to_pylist(), strict=True):
            own = own.values.to_numpy(zero_copy_only=False).astype(np.int64)
            bins = np.frombuffer(population, np.uint16)[: len(own)].astype(np.int64)
            order = np.argsort(bins, kind="stable")
            before = np.cumsum(own[order]) - own[order]
            first = np.flatnonzero(np.diff(bins[order], prepend=-1))
            offset = np.empty(len(own), np.int64)
            offset[order] = before - np.repeat(before[first], np.diff(np.append(first, len(own))))
            load = np.bincount(bins, weights=own).astype(np.int64)[bins]
            out.append([{"bin": b, "offset": o, "load": n} for b, o, n in zip(bins.tolist(), offset.tolist(), load.tolist(), strict=True)])
        return pa.array(out, pa.list_(pa.struct([("bin", pa.int32()), ("offset", pa.int64()), ("load", pa.int64())])))

    return place


def evolved(rest: DataFrame, islands: int, level: int, *, capacity: int = CAPACITY, epochs: int = EPOCHS, size: int = POPULATION, children: int = CHILDREN) -> DataFrame:
    """Written pieces of less than ``capacity`` with island, bin, offset and the bin's load, after all epochs."""
    columns = [c for c in rest.columns if c != "length"]
    dealt = rest.withColumn("island", F.pmod(F.xxhash64("row", "piece"), F.lit(islands)).cast("int"))
    members = F.sort_array(F.collect_list(F.struct("length", "row", "piece", *[c for c in columns if c not in ("row", "piece")])), asc=False)
    now = dealt.groupBy("island").agg(members.alias("members"))
    now = materialize(now.withColumns({"population": F.lit(None).cast("binary"), "elite": F.lit(None).cast("array<array<int>>")}), "islands")
    for epoch in range(epochs):
        came = now.select(F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elite").alias("come")) if epoch and islands > 1 else None
        ready = now if came is None else now.join(came, "island", "left")
        come = F.lit(None).cast("array<array<int>>") if came is None else F.col("come")
        evolve = _evolver(level, epoch, capacity, size, children)
        done = ready.withColumn("done", evolve("island", F.transform("members", lambda m: m["length"]), "population", come))
        new = materialize(done.select("island", "members", "done.population", "done.elite"), "islands")
        discard(now)
        now = new
    placed = _placer(capacity)(F.transform("members", lambda m: m["length"]), F.col("population"))
    return now.select("island", F.inline(F.arrays_zip("members", placed.alias("placed")))).select("island", "members.*", "placed.*")


def pack(cut_up: DataFrame, *, capacity: int = CAPACITY, island: int = ISLAND, epochs: int = EPOCHS, size: int = POPULATION, children: int = CHILDREN, loose: float = LOOSE) -> DataFrame:
    """Written ``pieces`` with the sequence of each and its place there."""
    columns = cut_up.columns
    whole = cut_up.where(F.col("length") == capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest, level, parts = cut_up.where(F.col("length") < capacity), 0, [whole]
    n = rest.count()
    while n:
        islands = -(-n // island)
        done = evolved(rest, islands, level, capacity=capacity, epochs=epochs, size=size, children=children)
        number = ((F.lit(level).cast("bigint") * (1 << 40)) + F.col("island")) * (1 << 20) + F.col("bin")
        slack = F.col("load") < F.lit(loose * capacity)
        again = done.where(slack).count() if islands > 1 else 0
        going = bool(again) and 2 * again <= n
        parts.append((done.where(~slack) if going else done).select(*columns, number.alias("sequence_id"), "offset"))
        if not going:
            break
        rest, n, level = done.where(slack).select(columns), again, level + 1
    return functools.reduce(DataFrame.unionByName, parts)
