"""Language identification in two steps: the family, then linear machines between its languages.

Each text becomes relative frequencies of hashed byte bigrams and trigrams of
its letters (case folded, everything else one blank). A linear support vector
machine for each family against the rest picks the family; one machine for each
pair of the family's languages votes for the language. Machines are fitted with
squared hinge loss on at most ``per_language`` labelled rows a language and
``MAX_ROWS`` in all, chosen by hash of the id, so the fit has one size at every
corpus size. The model is a few thousand weights a machine.

Defined results: null text, empty text and text without a letter give ``und``
and score 0; so does every text where there was no labelled row to learn from.
With one learned language every text with letters gets it, score 1. Rows are
judged one by one, so ties, repeated rows and null ids need no rule.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.bytestext import blocks, row_sums
from tidewell.llm.sqlx import fresh, unused

#: Families of closely related languages. A language not listed is its own family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "bg", "sr", "hr", "bs", "sl", "mk", "cs", "sk", "pl"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa"),
    "semitic": ("ar", "he", "mt"),
}
BINS = 1 << 13
PER_LANGUAGE = 400
MAX_ROWS = 3000
#: Scores below this are rejected by ``accepted``.
MIN_SCORE = 0.3
UNKNOWN = "und"
#: Training rows travel as half precision, scaled by this.
_HALF = np.float32(256)

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_ASCII = np.zeros(256, bool)
_ASCII[0x61:0x7B] = True


def family(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang in langs), lang)


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bins of the trigrams that start at each byte of the padded text, of bigrams, which count, and offsets."""
    n, rows = len(data), len(offsets) - 1
    pad = np.full(n + 2 * rows, 0x20, np.uint8)
    shift = offsets + 2 * np.arange(rows + 1)
    keep = np.ones(len(pad), bool)
    keep[shift[:-1]] = False
    keep[shift[1:] - 1] = False
    low = _FOLD[data]
    if n > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][upper] += 0x20
    pad[keep] = low
    a = pad.astype(np.uint32)
    b, c = np.roll(a, -1), np.roll(a, -2)
    two = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)
    three = two + c * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F)
    cut = np.uint32(32 - BINS.bit_length() + 1)
    ink = pad != 0x20
    real2 = ink | np.roll(ink, -1)
    real2[shift[1:] - 1] = False
    real3 = real2 | np.roll(ink, -2)
    real3[shift[1:] - 1] = False
    real3[shift[1:] - 2] = False
    return (two >> cut).astype(np.int32), real2, (three >> cut).astype(np.int32), real3, shift, pad


def _has_letter(texts: pa.Array, at: int, pad: np.ndarray, shift: np.ndarray) -> np.ndarray:
    found = np.add.reduceat(_ASCII[pad].astype(np.int64), shift[:-1]) > 0
    for i in np.flatnonzero(~found):
        text = texts[at + int(i)].as_py()
        found[i] = bool(text) and any(ch.isalpha() for ch in text)
    return found


@dataclass
class Model:
    """Weights of the machines: rows of ``weights`` are machines, the last column is the bias."""

    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, BINS + 1), np.float32))


def frequencies(texts: pa.Array) -> np.ndarray:
    """Relative frequencies of the bins of each text: the training rows."""
    out = np.zeros((len(texts), BINS), np.float32)
    for at, rows, data, offsets in blocks(texts):
        two, real2, three, real3, shift, _ = _grams(data, offsets)
        for i in range(rows):
            s = slice(shift[i], shift[i + 1])
            c = np.bincount(two[s][real2[s]], minlength=BINS) + np.bincount(three[s][real3[s]], minlength=BINS)
            out[at + i] = c / max(1, c.sum())
    return out


def _machine(z: np.ndarray, norm: np.ndarray, y: np.ndarray, scale: np.ndarray, ridge: float = 1e-2, steps: int = 120) -> np.ndarray:
    """Weights and bias that minimise ridge/2 |w|^2 + weighted mean squared hinge, by accelerated gradient.

    ``z`` holds scaled rows, ``norm`` their squared lengths; rows with y = 0 do not count."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), np.where(y < 0, 0.5 / max(1, (y < 0).sum()), 0)).astype(np.float32)
    top = float((share * (norm + 1)).sum()) * 2 + ridge
    w = v = np.zeros(z.shape[1], np.float32)
    b = u = 0.0
    for t in range(steps):
        gap = np.maximum(0, 1 - y * (z @ v + u))
        pull = -2 * share * gap * y
        w1, b1 = v - (pull @ z + ridge * v) / top, u - float(pull.sum()) / top
        k = t / (t + 3)
        v, u = w1 + k * (w1 - w), b1 + k * (b1 - b)
        w, b = w1, b1
    return np.append(w * scale, np.float32(b)).astype(np.float32)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = PER_LANGUAGE, max_rows: int = MAX_ROWS) -> Model:
    """Fit on labelled rows, at most ``per_language`` a language and ``max_rows`` in all."""
    labelled = docs.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, text_col, label_col)
    langs = sorted(r[0] for r in labelled.select(label_col).distinct().limit(max_rows).collect())
    if not langs:
        return Model()
    each = max(1, min(per_language, max_rows // len(langs)))
    turn = Window.partitionBy(label_col).orderBy(F.xxhash64(id_col), id_col)
    chosen = labelled.select(id_col, label_col).withColumn("_r", F.row_number().over(turn)).where(F.col("_r") <= each).select(F.col(id_col).alias("_i")).distinct()

    @F.arrow_udf("binary")
    def row(texts: pa.Array) -> pa.Array:
        halves = ((frequencies(texts.slice(part, 64)) * _HALF).astype(np.float16) for part in range(0, len(texts), 64))
        return pa.array([v.tobytes() for part in halves for v in part], pa.binary())

    picked = labelled.join(F.broadcast(chosen), F.col(id_col) == F.col("_i"), "left_semi").select(F.col(label_col).alias("y"), row(F.col(text_col)).alias("x"))
    rows = picked.collect()
    x = np.empty((len(rows), BINS), np.float32)
    for i, r in enumerate(rows):
        np.divide(np.frombuffer(r["x"], np.float16), _HALF, out=x[i], casting="unsafe", dtype=np.float32)
    y = np.array([r["y"] for r in rows])
    del rows
    mean = x.mean(0)
    spread = np.sqrt(np.maximum(0, np.einsum("ij,ij->j", x, x) / len(x) - mean * mean))
    scale = (1 / (spread + 1e-4)).astype(np.float32)
    x *= scale
    norm = np.einsum("ij,ij->i", x, x)
    model = Model()
    for lang in langs:
        model.languages.setdefault(family(lang), []).append(lang)
    model.families = sorted(model.languages)
    fam = np.array([family(v) for v in y])
    made = [_machine(x, norm, np.where(fam == f, 1, -1).astype(np.float32), scale) for f in model.families] if len(model.families) > 1 else []
    for f in model.families:
        for a, b in itertools.combinations(model.languages[f], 2):
            model.pairs.append((a, b))
            made.append(_machine(x, norm, np.where(y == a, 1, np.where(y == b, -1, 0)).astype(np.float32), scale))
    if made:
        model.weights = np.stack(made)
    return model


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    out, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not model.families:
        return out, score
    many = len(model.families) > 1
    langs = [v for f in model.families for v in model.languages[f]]
    home = {v: k for k, f in enumerate(model.families) for v in model.languages[f]}
    bins = np.ascontiguousarray(model.weights[:, :-1])
    for at, rows, data, offsets in blocks(texts):
        two, real2, three, real3, shift, pad = _grams(data, offsets)
        letters = _has_letter(texts, at, pad, shift)
        n = np.maximum(1, row_sums(real2.astype(np.float64) + real3, shift))
        margin = np.empty((len(bins), rows))
        for k, w in enumerate(bins):
            margin[k] = row_sums(w[two] * real2 + w[three] * real3, shift) / n + model.weights[k, -1]
        fams = margin[: len(model.families)] if many else np.zeros((1, rows))
        best = fams.argmax(0)
        sure = _sigmoid(3 * fams.max(0)) if many else np.ones(rows)
        votes, push, ties = np.zeros((len(langs), rows)), np.zeros((len(langs), rows)), np.zeros(len(langs))
        for k, (a, b) in enumerate(model.pairs, len(model.families) if many else 0):
            i, j = langs.index(a), langs.index(b)
            p = _sigmoid(3 * margin[k])
            votes[i] += p >= 0.5
            votes[j] += p < 0.5
            push[i] += p
            push[j] += 1 - p
            ties[i] += 1
            ties[j] += 1
        mean = np.where(ties[:, None] > 0, push / np.maximum(1, ties)[:, None], 1.0)
        inside = np.array([home[v] for v in langs])[:, None] == best[None, :]
        win = np.where(inside, votes + mean / 2, -1).argmax(0)
        for i in np.flatnonzero(letters):
            out[at + i] = langs[win[i]]
            score[at + i] = sure[i] * mean[win[i], i]
    return out, score


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", lang_as: str = "lang_pred", score_as: str = "lang_score") -> DataFrame:
    """``docs`` with two new columns: the language and its score, 0 to 1."""
    unused(docs, lang_as), unused(docs, score_as)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def judge(texts: pa.Array) -> pa.Array:
        langs, scores = predict(shared.value, texts)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    at = fresh(docs, "_judged")
    return docs.withColumn(at, judge(F.col(text_col))).withColumns({lang_as: F.col(at)["lang"], score_as: F.col(at)["score"]}).drop(at)


def accepted(judged: DataFrame, *, lang_col: str = "lang_pred", score_col: str = "lang_score", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows whose language is known well enough, without the two columns that tell it."""
    return judged.where((F.col(lang_col) != UNKNOWN) & (F.col(score_col) >= min_score)).drop(lang_col, score_col)


def held_out(part: int, remainder: int, id_col: str = "doc_id"):
    """crc32 of the id as text, modulo ``part``, is ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % part == remainder, F.lit(False))
