"""Vector codes against Lloyd rounds in plain integers."""

import math
import random

import numpy as np
import pytest

from airwave.llm import codes


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(v, lab, [math.floor(x * scale) for x in e]) for v, lab, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    sizes = [len(e) for _, _, e in kept if e and len(e) % parts == 0]
    d = max(sorted(set(sizes)), key=sizes.count) if sizes else 0
    good = [k for k in kept if len(k[2]) == d and d and max(map(abs, k[2])) < min(1 << 30, int((2**62 / d) ** 0.5) // 2)]
    w = d // parts
    first = sorted(good, key=lambda k: (k[0] is None, k[0], k[2]) if k[0] is not None else (True, 0, k[2]))[:entries]
    out, books = {i: [[], 0] for i in range(len(good))}, []
    for p in range(parts):
        x = [k[2][p * w : p * w + w] for k in good]
        book = [k[2][p * w : p * w + w] for k in first]
        far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b))
        near = lambda a: min(range(len(book)), key=lambda e: (far(a, book[e]), e))  # noqa: E731,B023
        for _ in range(rounds):
            own = [near(a) for a in x]
            for e in range(len(book)):
                mine = [a for a, o in zip(x, own) if o == e]
                if mine:
                    book[e] = [sum(c) // len(mine) for c in zip(*mine)]
        for i, a in enumerate(x):
            e = near(a)
            out[i][0].append(e)
            out[i][1] += far(a, book[e])
        books.append(book)
    rest = [(k[0], k[1], None, None) for k in kept if k not in good]
    return [(good[i][0], good[i][1], c, e) for i, (c, e) in out.items()] + rest, books


def some_rows():
    rnd = random.Random(4)
    centre = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, i % 3 if i % 7 else None, [float(np.float32(c + rnd.gauss(0, 0.3))) for c in centre[i % 6]]) for i in range(160)]
    rows += [(500 + i, 9, list(rows[0][2])) for i in range(60)]  # one vector over many rows
    rows += [(3, 1, list(rows[9][2])), (3, 1, list(rows[9][2])), (None, 2, list(rows[4][2])), (700, 1, None), (701, 1, [1.0] * 7 + [None]), (702, 1, [float("nan")] * 8), (703, 1, [float("inf")] + [0.0] * 7)]
    rows += [(704, 1, [1.0] * 4), (705, 5, []), (706, 5, [1.0] * 7), (707, 6, [3e38] + [0.0] * 7), (708, 6, [0.0] * 8), (709, 6, [-0.0005] * 8)]
    return rows


@pytest.mark.parametrize("members,entries", [(1024, 12), (5, 12), (7, 256)])
def test_codes_equal_plain_rounds(spark, monkeypatch, members, entries):
    """In owners of one group and of many, with fewer and with more entries than vectors."""
    monkeypatch.setattr(codes, "MEMBERS", members)
    rows = some_rows()
    d = spark.createDataFrame([(*r, "s", 1) for r in rows], "vec_id long, label int, embedding array<float>, salt string, pos int").repartition(3)
    got, books = codes.quantize(d, entries=entries)
    want, book = brute(rows, entries=entries)
    assert books.tolist() == book
    assert sorted(((r["vec_id"], r["label"], r["codes"], r["error"]) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_label_error(spark, monkeypatch):
    monkeypatch.setattr(codes, "HOT", 3)  # one label by broadcast, the others by shuffle
    rows = [(i, 1 if i < 20 else (None if i < 25 else i % 4 + 2), [i % 256], i) for i in range(40)] + [(99, 1, None, None)]
    got = {r["vec_id"]: r["label_error"] for r in codes.with_label_error(spark.createDataFrame(rows, "vec_id long, label int, codes array<int>, error long")).collect()}
    for v, lab, _, e in rows:
        assert got[v] == (None if e is None else sum(x for _, other, _, x in rows if other == lab and x is not None))


def test_nearest_is_exact_beyond_float_products():
    book = np.array([[1 << 28, 0], [(1 << 28) - 1, 1], [(1 << 28) - 1, 1]], np.int64)
    entry, dist = codes.nearest(np.array([[(1 << 28) - 1, 1], [1 << 28, 0], [(1 << 28) - 1, 0]], np.int64), book)
    assert entry.tolist() == [1, 0, 0] and dist.tolist() == [0, 0, 1]


def test_only_other_lengths_and_no_rows(spark):
    d = spark.createDataFrame([(1, 1, [1.0, 2.0]), (2, None, [])], "vec_id long, label int, embedding array<double>")
    got, books = codes.quantize(d)
    assert sorted(map(tuple, got.collect())) == [(1, 1, None, None), (2, None, None, None)] and books.size == 0
    assert codes.with_label_error(codes.quantize(d.limit(0))[0]).count() == 0
