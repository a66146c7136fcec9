"""Mixing sources to target weights by raking, then sampling with calibrated probabilities.

Documents fall in cells of source, language and topic. Iterative proportional
fitting scales the cells' tokens until the shares of each source, language and
topic are the wanted ones. A cell's rate is its wanted tokens over its tokens;
one factor makes the rates probabilities (at most 1) whose expected tokens are
the budget, and each document stays when a keyed hash falls below its cell's
probability. Cells are counts, not documents; up to ``MAX_CELLS`` they are
raked on the driver, more are raked as a distributed table by the same steps.

A topic is a given column, or the nearest of ``TOPICS`` centres that spherical
k-means finds among the hashed words of all documents; the steps add whole numbers, so
no order of rows changes a centre. Every document is then assigned by its whole text.

Defined results: null source or language is a category of its own; null, empty
and wordless texts have no tokens, topic -1, and the probability of their cell,
or the budget's share where the whole cell has no tokens; rows equal in id and
text draw the same lot; an empty table stays empty; marginals that cannot be met in
``STEPS`` steps give a warning and the last weights.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.bytestext import blocks, span_hashes, word_spans
from tidewell.llm.sqlx import fresh, unused
from tidewell.session import discard, gathered, materialize

DIMENSIONS = ("source", "lang", "topic")
TOPICS = 8
#: Words of as many bytes tell a topic, by hash bins.
TOPIC_WORD = 5
TOPIC_BINS = 1 << 10
#: Most steps of k-means.
TOPIC_STEPS = 12
MAX_CELLS = 200_000
STEPS = 60
TOLERANCE = 1e-9
#: Wanted shares are the present shares to this power, scaled: 1 keeps them, 0 makes them equal.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.5}
SHARE = 0.7
SEED = 11
NONE = "(none)"


def _bins(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (span_hashes(data, starts, ends) >> np.uint64(17)).astype(np.int64) % TOPIC_BINS


def _counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h, c) of each text: a hash, and pairs of a bin and its part of the text's length in 2^15ths."""

    @F.arrow_udf("binary")
    def counts(texts: pa.Array) -> pa.Array:
        out = []
        for _, n, data, offsets in blocks(texts):
            starts, ends, first = word_spans(data, offsets)
            long = np.flatnonzero((ends - starts) >= TOPIC_WORD)
            doc = np.searchsorted(first, long, "right") - 1
            key, count = np.unique(doc * TOPIC_BINS + _bins(data, starts[long], ends[long]), return_counts=True)
            row = key // TOPIC_BINS
            length = np.sqrt(np.bincount(row, weights=count.astype(float) ** 2, minlength=n))
            pairs = np.stack([key % TOPIC_BINS, np.maximum(1, np.rint(count * (2.0**15 / length[row])))], 1).astype(np.uint16)
            cut = np.searchsorted(row, np.arange(n + 1)).tolist()
            out += [pairs[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.array(out, pa.binary())

    return docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(F.col(id_col), F.xxhash64(F.col(text_col))).alias("h"), counts(F.col(text_col)).alias("c"))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Some rows of ``_counted`` that have pairs: the first pair of each row, and all bins and parts."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            some = batch.slice(at, 1000)
            c = some.column("c").cast(pa.large_binary())
            cut = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1] // 4
            pairs = np.frombuffer(c.buffers()[2], np.uint16)[2 * cut[0] : 2 * cut[-1]].reshape(-1, 2)
            yield some, cut[:-1] - cut[0], pairs[:, 0].astype(np.int64), pairs[:, 1].astype(float)


def _units(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """The same with parts weighted and scaled to vectors of length 1, in whole 2^15ths."""
    for some, first, bins, part in _pairs(batches):
        x = part * idf[bins]
        scale = 2.0**15 / np.maximum(1e-9, np.sqrt(np.add.reduceat(x * x, first)))
        yield some, first, bins, np.rint(x * np.repeat(scale, np.diff(np.append(first, len(x)))))


def _likeness(centre: np.ndarray, first: np.ndarray, bins: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Product of each row with each centre, a line each."""
    return np.stack([np.add.reduceat(c[bins] * x, first) for c in centre])


def _whole(centre: np.ndarray) -> np.ndarray:
    """Centres of length 1 in whole 2^20ths: products with whole vectors are exact in any order."""
    return np.rint(centre * (2.0**20 / np.maximum(1e-9, np.sqrt((centre * centre).sum(1, keepdims=True)))))


def fit_topics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", topics: int = TOPICS) -> np.ndarray:
    """Weights of ``TOPIC_BINS`` words for each topic, from all documents. Each step is a pass over the
    written counts; only sums by topic and bin, and one row a starting centre, come to the driver."""
    written = materialize(_counted(docs, id_col, text_col), "topics")
    table = written.where(F.length("c") > 0)

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, seen = 0, np.zeros(TOPIC_BINS, np.int64)
        for some, _, bins, _ in _pairs(batches):
            rows += some.num_rows
            seen += np.bincount(bins, minlength=TOPIC_BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, TOPIC_BINS)), pa.array(np.append(rows, seen))], ["bin", "n"])

    held = {r["bin"]: r["n"] for r in table.mapInArrow(holding, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    if not held.get(-1):
        return np.zeros((topics, TOPIC_BINS), np.float32)
    idf = np.log((1 + held[-1]) / (1 + np.array([held[k] for k in range(TOPIC_BINS)])))

    def start(chosen: np.ndarray) -> np.ndarray:
        """The row that is farthest from its nearest centre, by the smallest hash of ties."""

        def farthest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for some, first, bins, x in _units(batches, idf):
                near = (_likeness(chosen, first, bins, x).max(0) if len(chosen) else np.zeros(len(first))).astype(np.int64)
                h = some.column("h").to_numpy()
                k = int(np.lexsort((h, near))[0])
                if best is None or (near[k], h[k]) < best[:2]:
                    best = near[k], h[k], some.column("c")[k].as_py()
            if best is not None:
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in best], ["near", "h", "c"])

        found = table.mapInArrow(farthest, "near bigint, h bigint, c binary").orderBy("near", "h").first()
        row = pa.RecordBatch.from_arrays([pa.array([found["c"]], pa.binary())], ["c"])
        _, _, bins, x = next(_units(iter([row]), idf))
        return _whole(np.bincount(bins, weights=x, minlength=TOPIC_BINS)[None])

    def step(centre: np.ndarray) -> np.ndarray:
        """The sum of the vectors nearest to each centre; a centre without any stays."""

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(topics * TOPIC_BINS)
            for _, first, bins, x in _units(batches, idf):
                own = _likeness(centre, first, bins, x).argmax(0)
                total += np.bincount(np.repeat(own, np.diff(np.append(first, len(x)))) * TOPIC_BINS + bins, weights=x, minlength=len(total))
            on = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(on // TOPIC_BINS), pa.array(on % TOPIC_BINS), pa.array(total[on].astype(np.int64))], ["topic", "bin", "n"])

        total = np.zeros((topics, TOPIC_BINS))
        for r in table.mapInArrow(sums, "topic bigint, bin bigint, n bigint").groupBy("topic", "bin").agg(F.sum("n").alias("n")).collect():
            total[r["topic"], r["bin"]] = r["n"]
        return _whole(np.where(total.any(1, keepdims=True), total, centre))

    centre = np.zeros((0, TOPIC_BINS))  # centres far from each other to begin with
    for _ in range(topics):
        centre = np.concatenate([centre, start(centre)])
    for _ in range(TOPIC_STEPS):
        before, centre = centre, step(centre)
        if np.array_equal(before, centre):
            break
    discard(written)
    return (centre / 2.0**20 * idf).astype(np.float32)


def described(docs: DataFrame, weights: np.ndarray | None, *, text_col: str = "text", topic_col: str | None = None, name: str = "seen") -> DataFrame:
    """``docs`` with a new column ``name``: n_tokens and topic of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("struct<n_tokens:bigint,topic:int>")
    def look(texts: pa.Array) -> pa.Array:
        w = shared.value
        count, topic = np.zeros(len(texts), np.int64), np.full(len(texts), -1, np.int32)
        for at, rows, data, offsets in blocks(texts):
            starts, ends, first = word_spans(data, offsets)
            count[at : at + rows] = np.diff(first)
            if w is None:
                continue
            doc = np.repeat(np.arange(rows), np.diff(first))
            long = (ends - starts) >= TOPIC_WORD
            bins, doc = _bins(data, starts[long], ends[long]), doc[long]
            score = np.stack([np.bincount(doc, weights=v[bins], minlength=rows) for v in w])
            topic[at : at + rows] = np.where(np.bincount(doc, minlength=rows) > 0, score.argmax(0), -1)
        return pa.StructArray.from_arrays([pa.array(count), pa.array(topic)], ["n_tokens", "topic"])

    seen = docs.withColumn(unused(docs, name), look(F.col(text_col)))
    return seen if topic_col is None else seen.withColumn(name, F.struct(F.col(name)["n_tokens"].alias("n_tokens"), F.col(topic_col).alias("topic")))


def _keys(name: str) -> dict[str, Column]:
    """A described row's category in each dimension."""
    return {c: F.coalesce((F.col(name)["topic"] if c == "topic" else F.col(c)).cast("string"), F.lit(NONE)) for c in DIMENSIONS}


def cells(seen: DataFrame, name: str = "seen") -> DataFrame:
    """(source, lang, topic, tokens, docs) of a described table."""
    rows = seen.select(*[v.alias(c) for c, v in _keys(name).items()], F.col(name)["n_tokens"].alias("n"))
    return rows.groupBy(*DIMENSIONS).agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def wanted(marginal: dict[str, float], temper: float) -> dict[str, float]:
    """Tempered shares of the categories that have tokens."""
    raised = {k: v**temper for k, v in marginal.items() if v > 0}
    total = sum(raised[k] for k in sorted(raised))
    return {k: v / total for k, v in raised.items()}


def rake(codes: list[np.ndarray], tokens: np.ndarray, shares: list[np.ndarray], steps: int = STEPS) -> np.ndarray:
    """Cell weights, with the sum of ``tokens``, whose marginal shares are ``shares``."""
    w, total = tokens.astype(float), float(tokens.sum())
    for _ in range(steps):
        off = 0.0
        for code, share in zip(codes, shares, strict=True):
            now = np.bincount(code, weights=w, minlength=len(share))
            factor = np.divide(share * total, now, out=np.zeros_like(now), where=now > 0)
            off = max(off, float(np.abs(factor[now > 0] - 1).max(initial=0)))
            w = w * factor[code]
        if off < TOLERANCE:
            return w
    warnings.warn(f"raking is {off:.1e} off after {steps} steps", stacklevel=2)
    return w


def calibrate(rate: np.ndarray, tokens: np.ndarray, budget: float) -> float:
    """The factor f with sum(tokens * min(1, f * rate)) = budget."""
    order = np.argsort(-rate, kind="stable")
    r, t = rate[order], tokens[order].astype(float)
    full, rest = np.concatenate([[0.0], np.cumsum(t)]), np.concatenate([np.cumsum((r * t)[::-1])[::-1], [0.0]])
    for k in range(len(r)):
        f = (budget - full[k]) / rest[k] if rest[k] > 0 else np.inf
        if f * r[k] <= 1:
            return max(0.0, f)
    return np.inf


def probabilities(table: DataFrame, *, share: float = SHARE, temper: dict[str, float] = TEMPER, targets: dict[str, dict[str, float]] | None = None, max_cells: int = MAX_CELLS) -> DataFrame:
    """(source, lang, topic, p) for a written table of cells."""
    spark = table.sparkSession
    if table.limit(max_cells + 1).count() > max_cells:
        return _distributed(table, share, temper, targets or {})
    rows = sorted(table.collect(), key=lambda r: tuple(r[c] for c in DIMENSIONS))
    if not rows:
        return spark.createDataFrame([], "source string, lang string, topic string, p double")
    tokens = np.array([r["tokens"] for r in rows], np.int64)
    codes, shares = [], []
    for c in DIMENSIONS:
        names = sorted({r[c] for r in rows})
        code = np.array([names.index(r[c]) for r in rows]) if len(names) < 64 else np.searchsorted(np.array(names), np.array([r[c] for r in rows]))
        now = dict(zip(names, np.bincount(code, weights=tokens, minlength=len(names)).tolist(), strict=True))
        goal = (targets or {}).get(c) or wanted(now, temper.get(c, 1.0))
        total = sum(goal.get(n, 0.0) for n in names if now[n] > 0) or 1.0
        codes.append(code)
        shares.append(np.array([goal.get(n, 0.0) / total if now[n] > 0 else 0.0 for n in names]))
    w = rake(codes, tokens, shares)
    rate = np.divide(w, tokens, out=np.full(len(w), 1.0), where=tokens > 0)
    f = calibrate(rate[tokens > 0], tokens[tokens > 0], share * float(tokens.sum())) if tokens.sum() else 0.0
    p = np.where(tokens > 0, np.minimum(1.0, f * rate) if np.isfinite(f) else 1.0, share)
    return spark.createDataFrame([(*[r[c] for c in DIMENSIONS], float(x)) for r, x in zip(rows, p, strict=True)], "source string, lang string, topic string, p double")


def _distributed(table: DataFrame, share: float, temper: dict[str, float], targets: dict[str, dict[str, float]], steps: int = STEPS) -> DataFrame:
    """The same raking for more cells than a driver should hold: one written table a step."""
    total = float(table.agg(F.sum("tokens")).first()[0] or 0)
    now = table.withColumn("w", F.col("tokens").cast("double"))
    goals = {}
    for c in DIMENSIONS:
        if c in targets:
            goal = table.sparkSession.createDataFrame(list(targets[c].items()), f"{c} string, goal double")
        else:
            goal = table.groupBy(c).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper.get(c, 1.0))).alias("goal"), F.sum("tokens").alias("_n")).where("_n > 0").drop("_n")
        present = table.groupBy(c).agg(F.sum("tokens").alias("_n")).where("_n > 0").select(c).join(goal, c)
        goals[c] = materialize(present.withColumn("goal", F.col("goal") / present.agg(F.sum("goal")).scalar()), "goals")
    for _ in range(steps):
        off = F.lit(0.0)
        for c in DIMENSIONS:
            factor = now.groupBy(c).agg(F.sum("w").alias("_now")).join(goals[c], c, "left").select(c, F.when(F.col("_now") > 0, F.coalesce("goal", F.lit(0.0)) * total / F.col("_now")).otherwise(F.lit(0.0)).alias("_f"))
            now = now.join(factor, c).withColumn("w", F.col("w") * F.col("_f")).withColumn(f"_o_{c}", F.when(F.col("w") > 0, F.abs(F.col("_f") - 1)).otherwise(0.0)).drop("_f")
            off = F.greatest(off, F.col(f"_o_{c}"))
        now = materialize(now.withColumn("off", off).drop(*[f"_o_{c}" for c in DIMENSIONS]), "rake")
        now, off = now.drop("off"), float(now.agg(F.max("off")).first()[0] or 0)
        if off < TOLERANCE:
            break
    else:
        warnings.warn(f"raking is {off:.1e} off after {steps} steps", stacklevel=2)
    rated = materialize(now.select(*DIMENSIONS, "tokens", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(1.0).alias("rate")), "rates")
    # The factor is exact: cells that reach 1 stay there, and the rest share what is left of the budget.
    f, full = 0.0, -1
    while True:
        sure = F.lit(f) * F.col("rate") >= 1
        got = rated.where("tokens > 0").agg(F.count_if(sure).alias("n"), F.sum(F.when(sure, F.col("tokens"))).alias("spent"), F.sum(F.when(~sure, F.col("tokens") * F.col("rate"))).alias("rest")).first()
        if got["n"] == full or not got["rest"]:
            break
        full, f = got["n"], max(f, (share * total - float(got["spent"] or 0)) / got["rest"])
    return rated.select(*DIMENSIONS, F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(f) * F.col("rate"))).otherwise(share).alias("p"))


def lots(seen: DataFrame, p: DataFrame, *, name: str = "seen", id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """A described table whose column ``name`` also has the probability ``p`` of each row and whether it is ``kept``."""
    names = {c: fresh(seen, f"_{c}") for c in DIMENSIONS}
    at = fresh(seen, "_p")
    table = p.select(*[F.col(c).alias(names[c]) for c in DIMENSIONS], F.col("p").alias(at))
    lot = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))), 11) / F.lit(float(1 << 53))
    joined = seen.withColumns({names[c]: v for c, v in _keys(name).items()}).join(table, list(names.values()), "left")
    told = F.struct(F.col(name)["n_tokens"].alias("n_tokens"), F.col(name)["topic"].alias("topic"), F.col(at).alias("p"), (lot < F.col(at)).alias("kept"))
    return joined.select(*[told.alias(c) if c == name else F.col(c) for c in seen.columns])


def mix(docs: DataFrame, *, share: float = SHARE, temper: dict[str, float] = TEMPER, targets: dict[str, dict[str, float]] | None = None, topic_col: str | None = None, seed: int = SEED, name: str = "mixed") -> DataFrame:
    """Every row of ``docs`` with a new column ``name``: n_tokens, topic, p and kept."""
    seen = described(docs, fit_topics(docs) if topic_col is None else None, topic_col=topic_col, name=name)
    table = materialize(gathered(cells(seen, name)), "cells")
    return lots(seen, probabilities(table, share=share, temper=temper, targets=targets), name=name, seed=seed)
