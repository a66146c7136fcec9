"""Licence scans: a trained paragraph classifier, an unknown class, and templates that confirm.

Paragraphs end at blank lines. In one, every line and every run of up to ``RUN``
lines is judged, so a grant is found on one line, wrapped over several, or in the
midst of other text. The features are hashed word unigrams and bigrams (lower case,
letters and digits only). A sparse logistic regression, one weight vector for each
family of ``TEMPLATES`` and one for unknown text, is trained on the templates, varied
by dropped and surrounding words, against at most ``negatives`` lines of at most
``negative_docs`` documents of the corpus that match no template. Half of those, and
templates varied anew, are set aside: they give the temperature that makes the
probabilities true to their frequency, and the probability from which a family is
believed; below it the text is unknown. A believed family is confirmed when enough of
the bigrams of one of its templates occur. Of findings that overlap, the one that
covers most of a template stays, of those the shortest.

Defined results: null and empty texts have no findings; blank lines are never found;
a finding's ``paragraph`` is the place of its first line in the text, from 0; rows are scanned one by one,
so ties and repeated rows agree; without a corpus to train against the
classifier has the templates' words as its unknown class and still works.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.bytestext import blocks, mix, span_hashes
from tidewell.llm.sqlx import unused

BINS = 1 << 15
NEGATIVES = 6000
NEGATIVE_DOCS = 1500
#: Lines in a row that are judged as one.
RUN = 4
COVER = 0.6
#: Factors of the weights among which the calibration chooses.
HEATS = tuple(2.0 ** (k / 4) for k in range(-8, 9))
FALSE_RATE = 5e-4
UNKNOWN = "unknown"

#: Phrases by which public licences are named or granted, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Apache License Version 2.0, January 2004",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ),
    "agpl": ("Licensed under the GNU Affero General Public License, version 3.",),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0 Universal.",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "proprietary": ("All rights reserved.", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited.", "Proprietary and confidential."),
}
FAMILIES = tuple(TEMPLATES)

_SEPARATES = np.ones(256, bool)
_SEPARATES[0x30:0x3A] = _SEPARATES[0x61:0x7B] = _SEPARATES[0x80:] = False


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line of a block of lower-case text: its text, its place, and unigram and bigram bins with their line."""
    ink = ~_SEPARATES[data]
    left, right = ink.copy(), ink.copy()
    left[1:] &= ~ink[:-1]
    right[:-1] &= ~ink[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    left[edge], right[edge - 1] = ink[edge], ink[edge - 1]
    starts, ends = np.flatnonzero(left), np.flatnonzero(right) + 1
    h = span_hashes(data, starts, ends)
    breaks = np.flatnonzero(data == 0x0A)
    heads = np.concatenate([offsets[:-1], breaks + 1])
    doc = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((heads, doc))
    doc = doc[order]
    begin = np.searchsorted(starts, heads[order])
    size = np.append(begin[1:], len(starts)) - begin
    line = np.repeat(np.arange(len(doc)), size)
    two = mix(h[:-1] * np.uint64(3) + h[1:])
    inside = line[:-1] == line[1:] if len(line) > 1 else np.zeros(0, bool)
    bins = np.concatenate([h, two[inside]]) % np.uint64(BINS)
    return doc, np.arange(len(doc)) - np.searchsorted(doc, doc), bins.astype(np.int64), np.concatenate([line, line[:-1][inside]])


def _sparse(paragraphs: list[str]) -> list[np.ndarray]:
    """Bins of each paragraph (without line breaks)."""
    out: list[np.ndarray] = []
    for _, rows, data, offsets in blocks(pa.array([p.lower().replace("\n", " ") for p in paragraphs], pa.string())):
        _, _, bins, line = _grams(data, offsets)
        order = np.argsort(line, kind="stable")
        out += np.split(bins[order], np.cumsum(np.bincount(line, minlength=rows))[:-1])
    return out


def _bigrams(text: str) -> set[tuple[str, str]]:
    words = "".join(ch if ch.isalnum() else " " for ch in text.lower()).split()
    return set(zip(words, words[1:], strict=False)) or {(w, "") for w in words}


def cover(text: str, family: str) -> tuple[float, str]:
    """The largest share of a family's template that occurs in the text, and that template."""
    own = _bigrams(text)
    return max(((len(t & own) / len(t), s) for s in TEMPLATES[family] for t in [_bigrams(s)]), key=lambda x: x[0])


@dataclass
class Model:
    """Weights by bin and class (the last class is unknown) and the probability to believe."""

    weights: np.ndarray
    believe: float

    def sums(self, bins: np.ndarray, line: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights of each line's features, by class, and how many they are."""
        z = np.zeros((lines, self.weights.shape[1]))
        for k in range(z.shape[1]):
            z[:, k] = np.bincount(line, weights=self.weights[bins, k], minlength=lines)
        return z, np.bincount(line, minlength=lines)

    def judge(self, z: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Probabilities of the classes."""
        z = z / np.sqrt(np.maximum(1, size))[:, None]
        z[size == 0] = 0
        z[:, -1] += (size == 0) * 50.0
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def probability(self, bins: np.ndarray, line: np.ndarray, lines: int) -> np.ndarray:
        return self.judge(*self.sums(bins, line, lines))


def _examples(seed: int = 3) -> tuple[list[str], list[int]]:
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for k, family in enumerate(FAMILIES):
        for template in TEMPLATES[family]:
            words = template.split()
            for n in range(24):
                keep = rng.random(len(words)) > (0.1 if n else 0.0)
                around = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(0, 4)) * (n % 3))]
                texts.append(" ".join([*around, *(w for w, ok in zip(words, keep, strict=True) if ok)]))
                labels.append(k)
    return texts, labels


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", negatives: int = NEGATIVES, negative_docs: int = NEGATIVE_DOCS) -> Model:
    """Train on the templates and a bounded sample of the corpus's lines of 1 to 2000 characters."""
    some = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(id_col).alias("_o"), F.col(id_col).alias("_i")).orderBy("_o", "_i").limit(negative_docs).select("_i").distinct()
    lines = docs.join(F.broadcast(some), F.col(id_col).eqNullSafe(F.col("_i")), "left_semi").select(F.explode(F.split(text_col, "\n")).alias("p")).where(F.length("p").between(1, 2000))
    sample = [r[0] for r in lines.distinct().orderBy(F.xxhash64("p"), "p").limit(negatives).collect()]
    named = [t for ts in TEMPLATES.values() for s in ts for t in [_bigrams(s)]]
    plain = [p for p in sample if not any(len(t & g) / len(t) >= 0.5 for g in [_bigrams(p)] for t in named)]
    half = [p for p in plain if zlib.crc32(p.encode("utf-8", "surrogatepass")) % 2]
    aside = [p for p in plain if not zlib.crc32(p.encode("utf-8", "surrogatepass")) % 2]
    if not half:
        half = [" ".join(s.split()[::-3]) for ts in TEMPLATES.values() for s in ts]
    texts, labels = _examples()
    texts, labels = texts + half, labels + [len(FAMILIES)] * len(half)
    rows = _sparse(texts)
    y = np.array(labels)
    line = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    bins = np.concatenate(rows)
    used, at = np.unique(bins, return_inverse=True)
    model = Model(np.zeros((len(used), len(FAMILIES) + 1)), 0.5)
    share = np.where(y == len(FAMILIES), 1 / max(1, (y == len(FAMILIES)).sum()), 1 / max(1, (y < len(FAMILIES)).sum()))
    norm = np.sqrt(np.maximum(1, np.bincount(line, minlength=len(rows))))
    target = np.eye(len(FAMILIES) + 1)[y]
    speed = np.zeros_like(model.weights)
    for _ in range(150):
        p = model.probability(at, line, len(rows))
        pull = ((p - target) * (share / norm)[:, None])[line]
        for k in range(pull.shape[1]):
            g = np.bincount(at, weights=pull[:, k], minlength=len(used)) + 1e-5 * model.weights[:, k]
            speed[:, k] = 0.9 * speed[:, k] - 8.0 * g
        model.weights += speed
    # Small weights carry nothing: the kept model is sparse.
    model.weights[np.abs(model.weights) < 1e-3] = 0
    full = np.zeros((BINS, len(FAMILIES) + 1), np.float32)
    full[used] = model.weights
    model.weights = full
    if aside:
        r = _sparse(aside)
        new, label = _examples(5)
        r, label = r + _sparse(new), np.array([len(FAMILIES)] * len(aside) + label)
        z, size = model.sums(np.concatenate(r), np.repeat(np.arange(len(r)), [len(x) for x in r]), len(r))
        loss = lambda t: -np.log(np.maximum(1e-12, model.judge(z * t, size)[np.arange(len(label)), label])).mean()
        model.weights = (model.weights * (heat := min(HEATS, key=loss))).astype(np.float32)
        p = model.judge(z * heat, size)[: len(aside), :-1].max(1)
        model.believe = float(min(0.95, max(0.5, np.quantile(p, 1 - FALSE_RATE))))
    return model


def _settled(lines: list[str], found: list[tuple], cover_least: float) -> list[dict]:
    """Of (first line, lines, family, probability), those that overlap no better one, in order of place."""
    told = []
    for first, run, family, probability in found:
        text = " ".join(lines[first : first + run])
        share, template = cover(text, family)
        told.append({"paragraph": first, "family": family, "probability": probability, "template": template, "cover": share, "confirmed": share >= cover_least, "text": text, "run": run})
    told.sort(key=lambda x: (-round(x["cover"], 9), x["run"], -x["probability"], x["paragraph"]))
    kept, taken = [], set()
    for x in told:
        own = set(range(x["paragraph"], x["paragraph"] + x.pop("run")))
        if not own & taken:
            taken |= own
            kept.append(x)
    return sorted(kept, key=lambda x: x["paragraph"])


_FOUND = "array<struct<paragraph:int,family:string,probability:double,template:string,cover:double,confirmed:boolean,text:string>>"


def scan(docs: DataFrame, model: Model, *, text_col: str = "text", name: str = "licenses", cover_least: float = COVER) -> DataFrame:
    """``docs`` with an array of findings: the paragraphs in which a family is believed."""
    unused(docs, name)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(_FOUND)
    def find(texts: pa.Array) -> pa.Array:
        m = shared.value
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        for at, _, data, offsets in blocks(pc.utf8_lower(texts)):
            doc, place, bins, line = _grams(data, offsets)
            z, size = m.sums(bins, line, len(doc))
            spotted: dict[int, list[tuple]] = {}
            total, count, fits = z.copy(), size.copy(), size > 0
            for run in range(1, RUN + 1):
                if run > 1:  # one line more, where it belongs to the same text and is not blank
                    last = len(doc) - run + 1
                    if last < 1:
                        break
                    fits = fits[:last] & (size[run - 1 :] > 0) & (doc[:last] == doc[run - 1 :])
                    total, count = total[:last] + z[run - 1 :], count[:last] + size[run - 1 :]
                p = m.judge(total, count)
                best = p[:, :-1].argmax(1)
                top = p[np.arange(len(p)), best]
                for i in np.flatnonzero(fits & (top >= m.believe) & (top > p[:, -1])):
                    spotted.setdefault(int(doc[i]), []).append((int(place[i]), run, FAMILIES[best[i]], float(top[i])))
            for row, found in spotted.items():
                out[at + row] = _settled(texts[at + row].as_py().split("\n"), found, cover_least)
        kind = pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("template", pa.string()), ("cover", pa.float64()), ("confirmed", pa.bool_()), ("text", pa.string())])
        return pa.array(out, pa.list_(kind))

    return docs.withColumn(name, find(F.col(text_col)))
