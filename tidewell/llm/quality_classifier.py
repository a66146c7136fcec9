"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

``statistics`` describes a text by ``len(NAMES)`` numbers. Random Fourier
features approximate a Gaussian kernel over the standardised statistics. Each
partition sums its own part of the normal equations, a second step sums those
sums in ``SLOTS`` groups, and the driver solves one ``FEATURES`` x ``FEATURES``
system. A share of the labelled rows is set aside; their scores, counted in
``CELLS`` cells, give the isotonic calibration by pooling adjacent violators.
What reaches the driver has the same size for every corpus.

Defined results: a null text counts as empty; an empty text has the statistics
of zero words and gets a score like any other; several labels of one id are
averaged, null labels and labels of null ids are ignored; without labels, or where
none of the few there are is set aside for the calibration, every score is 0.5; rows are scored one by one, so ties and repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.bytestext import blocks, mix, row_sums, span_hashes, word_spans
from tidewell.llm.sqlx import unused
from tidewell.session import materialize

NAMES = ("log_words", "log_bytes", "word_length", "symbols", "upper", "digits", "stops", "bangs", "bars", "new_words", "repeats", "lines", "new_lines", "wide", "dots")
FEATURES = 160
BANDWIDTH = 3.0
RIDGE = 1e-3
SLOTS = 16
CELLS = 512
SEED = 20240607


def _mask(chars: str) -> np.ndarray:
    m = np.zeros(256, bool)
    m[np.frombuffer(chars.encode(), np.uint8)] = True
    return m


_CLASSES = [_mask("#*$%&<>@^~=_{}[]\\/"), _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("0123456789"), _mask(".,;:"), _mask("!?"), _mask("|")]


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics for each text."""
    out = np.zeros((len(texts), len(NAMES)))
    for at, rows, data, offsets in blocks(texts):
        starts, ends, first = word_spans(data, offsets)
        size = np.diff(offsets).astype(float)
        n = np.diff(first).astype(float)
        doc = np.repeat(np.arange(rows), np.diff(first))
        h = span_hashes(data, starts, ends)
        keyed = h ^ mix(doc.astype(np.uint64))
        _, where = np.unique(keyed, return_index=True)
        fresh = np.bincount(doc[where], minlength=rows)
        again = np.zeros(len(h))
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        breaks = data == 0x0A
        lines = row_sums(breaks, offsets) + (size > 0)
        cut = np.flatnonzero(breaks)
        s = np.unique(np.concatenate([offsets[:-1], cut + 1]))
        s = s[s < len(data)]
        e = np.append(s[1:], len(data))
        row_of = np.searchsorted(offsets, s, "right") - 1
        lh = span_hashes(data, s, e) ^ mix(row_of.astype(np.uint64)) if len(s) else np.zeros(0, np.uint64)
        _, lw = np.unique(lh, return_index=True)
        fresh_lines = np.bincount(row_of[lw], minlength=rows) if len(s) else np.zeros(rows)
        shares = np.stack([row_sums(m[data], offsets) for m in _CLASSES], 1) / np.maximum(1, size)[:, None]
        one = np.maximum(1, n)
        out[at : at + rows] = np.column_stack([
            np.log1p(n), np.log1p(size), row_sums((ends - starts).astype(float), first) / one, shares[:, 0], shares[:, 1], shares[:, 2], shares[:, 3], shares[:, 4], shares[:, 5],
            fresh / one, row_sums(again, first) / one, np.log1p(lines), fresh_lines / np.maximum(1, lines), row_sums(data >= 0x80, offsets) / np.maximum(1, size), row_sums(data == 0x2E, offsets) / one,
        ])
    return out


@dataclass
class Model:
    """Centre and scale of the statistics, ridge weights of the features, calibrated points."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    points: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        w = rng.standard_normal((len(NAMES), FEATURES - 1)) / BANDWIDTH
        b = rng.uniform(0, 2 * np.pi, FEATURES - 1)
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        return np.column_stack([np.sqrt(2 / (FEATURES - 1)) * np.cos(z @ w + b), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        at, value = self.points
        return np.clip(np.interp(self.raw(x), at, value), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of an array<double> column."""
    return np.asarray(column.flatten(), float).reshape(len(column), len(NAMES))


def with_statistics(docs: DataFrame, text_col: str = "text", name: str = "stats") -> DataFrame:
    @F.arrow_udf("array<double>")
    def stats(texts: pa.Array) -> pa.Array:
        rows = statistics(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, len(NAMES)), pa.int32()), pa.array(rows.ravel()))

    return docs.withColumn(unused(docs, name), stats(F.col(text_col)))


def isotonic(at: np.ndarray, hits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing shares by pooling adjacent violators; each block shrunk by one row of 0.5."""
    pools: list[list[float]] = []
    for x, y, m in zip(at, hits, n, strict=True):
        pools.append([x * m, y, m])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.maximum.accumulate([(p[1] + 0.5) / (p[2] + 1) for p in pools])


def fit(described: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", stats_col: str = "stats") -> Model | None:
    """Fit on the rows of ``described`` whose id has a label in ``labels``; None without any."""
    truth = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_l")).agg(F.avg(F.col(label_col)).alias("y"))
    rows = materialize(
        described.select(F.col(id_col).alias("_i"), F.col(stats_col).alias("x"))
        .join(truth, F.col("_i") == F.col("_l"))
        .select("x", "y", (F.pmod(F.xxhash64("_i"), F.lit(4)) == 0).alias("aside")),
        "quality",
    )
    moments = rows.agg(F.count("*"), *[f(F.get("x", F.lit(i))) for i in range(len(NAMES)) for f in (F.avg, F.stddev_pop)]).first()
    if not moments[0]:
        return None
    model = Model(np.array(moments[1::2], float), np.array(moments[2::2], float) + 1e-6, np.zeros(FEATURES), (np.zeros(1), np.full(1, 0.5)))
    size = FEATURES * (FEATURES + 1)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last = np.zeros((FEATURES, FEATURES + 1)), 0
        for batch in batches:
            z = model.features(_matrix(batch["x"]))
            total += z.T @ np.column_stack([z, np.asarray(batch["y"], float)])
            last = int(np.asarray(batch["y"], float).sum() * 1000) + batch.num_rows
        yield pa.record_batch({"slot": pa.array([last % SLOTS], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for v in table["sums"]:
            total += np.frombuffer(v.as_py())
        return pa.table({"slot": table["slot"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    sums = rows.where(~F.col("aside")).select("x", "y").mapInArrow(partial, "slot int, sums binary").groupBy("slot").applyInArrow(add, "slot int, sums binary")
    total = np.zeros(size)
    for r in sums.select("sums").collect():
        total += np.frombuffer(r[0])
    total = total.reshape(FEATURES, FEATURES + 1)
    count = max(1.0, total[-1, -2])
    model.weights = np.linalg.solve(total[:, :-1] / count + RIDGE * np.eye(FEATURES), total[:, -1] / count)

    @F.arrow_udf("double")
    def raw(x: pa.Array) -> pa.Array:
        return pa.array(model.raw(_matrix(x)))

    cell = F.floor((F.least(F.greatest("s", F.lit(-0.5)), F.lit(1.5)) + 0.5) * (CELLS / 2)).alias("cell")
    held = rows.where("aside").select(raw("x").alias("s"), "y").groupBy(cell).agg(F.avg("s").alias("s"), F.sum("y").alias("hits"), F.count("*").alias("n")).orderBy("cell").collect()
    if held:
        model.points = isotonic(np.array([r["s"] for r in held]), np.array([r["hits"] for r in held]), np.array([r["n"] for r in held], float))
    return model


def score(described: DataFrame, model: Model | None, *, stats_col: str = "stats", name: str = "score") -> DataFrame:
    """``described`` with the calibrated score, 0 to 1."""
    unused(described, name)
    if model is None:
        return described.withColumn(name, F.lit(0.5))

    @F.arrow_udf("double")
    def judge(x: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(x)))

    return described.withColumn(name, judge(F.col(stats_col)))
