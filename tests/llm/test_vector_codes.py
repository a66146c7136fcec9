"""Heap Lloyd against plain Lloyd on small tables, and the query's whole rows against SQL."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from tidewell import compare
from tidewell.llm import registry, vector_codes

SCHEMA = "vec_id bigint, embedding array<double>, label int, _of string, rows string, n int, x string, state string"


def rows_of(vectors):
    return [(i, None if v is None else [None if c is None else float(c) for c in v], g, "o", "r", 1, "x", "s") for i, v, g in vectors]


def plain(rows, entries=256, rounds=4, parts=4):
    """Every part against every entry in every round, with Python's whole numbers."""
    kept = [(i, [int(np.floor(1024 * x)) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for c in cut:
                held[nearest(c[p], books[p])[1]].append(c[p])
            for e, got in held.items():
                books[p][e] = [sum(col) // len(got) for col in zip(*got, strict=True)]
    best = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    total = defaultdict(int)
    for (_, _, g), b in zip(kept, best, strict=True):
        total[g] += sum(d for d, _ in b)
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in b), sum(d for d, _ in b), total[g], digest) for (i, _, g), b in zip(kept, best, strict=True)]


def told(df):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect()), key=repr)


def made(n, width, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, width)) * scale
    out = [(int(i), (centres[i % 9] + rng.normal(size=width) * scale / 4).tolist(), None if i % 5 == 0 else int(i % 3)) for i in rng.permutation(n)]
    return out + [(int(i), [0.0] * width, 1) for i in range(n, n + 40)]  # a group of copies, and ties


@pytest.mark.parametrize("n, width, entries, scale", [(300, 8, 16, 1.0), (150, 4, 256, 0.01), (200, 12, 2, 50.0), (60, 16, 1, 1.0), (200, 8, 32, 4e4)])
def test_plain_lloyd(spark, monkeypatch, n, width, entries, scale):
    monkeypatch.setattr(vector_codes, "MOST", 64)  # several blocks in a partition
    data = made(n, width, n, scale)
    got = vector_codes.compress(spark.createDataFrame(rows_of(data), SCHEMA), entries=entries)
    assert told(got) == sorted(plain(data, entries), key=repr)
    assert {"_of", "rows", "n", "x", "state"} <= set(got.columns)


def test_heaps_spare_most_scans():
    """Later rounds rescan only parts whose bounds were violated."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 8)) * 100
    x[:3600] = np.repeat(rng.normal(size=(40, 8)) * 4000, 90, 0) + x[:3600] / 50
    x = x.astype(np.int64)
    books = vector_codes.Codebooks([x[::100][:40]], [np.zeros(40)])
    state, changes = vector_codes.advance(x, None, books, 1)
    assert sum(c[3] for c in changes if c[2] < 0) == len(x)
    after = books.moved([books.entries[0] + (np.arange(40) % 2)[:, None]])
    heaps = [list(zip(k.tolist(), m.tolist(), strict=True)) for _, k, m in vector_codes._heaps(state, 40, len(x))][0]
    sizes = next(vector_codes._heaps(state, 40, len(x)))[0]
    cut = np.cumsum(sizes)[:-1].tolist()
    split = [list(map(tuple, h)) for h in np.split(np.array(heaps, dtype=object), cut)]
    popped, _ = vector_codes._popped([sorted(h) for h in split], after.drift[0])
    assert 0 < len(popped) < len(x) // 2
    again, _ = vector_codes.advance(x, state, after, 1)
    sizes, _, members = next(vector_codes._heaps(again, 40, len(x)))
    own = np.empty(len(x), np.int64)
    own[members] = np.repeat(np.arange(40), sizes)
    assert (own == vector_codes.squares(x, after.entries[0]).argmin(1)).all()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(None, [1.0, 2, 3, 4], 1), (1, None, 1), (2, [1.0, None, 3, 4], None), (3, [nan, 1, 1, 1], None), (4, [inf, 1, 1, 1], 2), (5, [-0.5, 0.25, 1e-9, -1e-9], None), (5, [-0.5, 0.25, 1e-9, -1e-9], None), (6, [-inf, 1, 1, 1], 2), (7, [9.0, 9, 9, 9], 2)]
    assert told(vector_codes.compress(spark.createDataFrame(rows_of(data), SCHEMA))) == sorted(plain(data), key=repr)
    for none in ([], [(1, None, 1)]):
        got = vector_codes.compress(spark.createDataFrame(rows_of(none), SCHEMA))
        assert got.collect() == [] and dict(got.dtypes)["error"] == "bigint"
    empty = vector_codes.compress(spark.createDataFrame(rows_of([(1, [], 1), (2, [], None)]), SCHEMA))
    assert [r[1:4] for r in told(empty)] == [("00000000", 0, 0)] * 2
    for bad in ([(1, [1.0] * 5, 1)], [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [1e9] * 4, 1)]):
        with pytest.raises(ValueError):
            vector_codes.compress(spark.createDataFrame(rows_of(bad), SCHEMA))
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 4, 1, "c")], "vec_id int, embedding array<double>, label int, code string"))


def test_query_and_sql(spark):
    assert compare.difference(spark, "/root/testdata/sf0.001", registry.queries()["op11_vector_codes"], registry.oracle_sql()["op11_vector_codes"]) == ""
