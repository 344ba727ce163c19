"""Benchmark decontamination against brute force."""

import random
import re

import pytest

from airwave.llm import leaks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, items, width=10):
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = words(t)
        k = min(width, len(w))
        for p in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[p : p + k]), set()).add(i)
    sizes = {len(g) for g in windows}
    out = []
    for d, t in rows:
        w, hit, ids = words(t), set(), set()
        for k in sizes:
            for p in range(len(w) - k + 1):
                if (g := tuple(w[p : p + k])) in windows:
                    hit.update(range(p, p + k))
                    ids |= windows[g]
        out.append((d, len(w), len(hit), sorted(i for i in ids if i is not None)))
    return sorted(out, key=repr)


def tables():
    rnd = random.Random(8)
    vocabulary = ["A", "bé", "c3", "日本", "the", "of", "x"]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, say(rnd.randint(9, 40))) for i in range(30)] + [(30, "Lone"), (31, "two Words"), (32, None), (33, "?!"), (None, "no id here"), (34, "Lone"), (34, "other lone thing"), (35, say(12)), (35, "lone")]
    rows = []
    for d in range(80):
        a, b = rnd.choice(items)[1] or "", rnd.choice(items)[1] or ""
        parts = [say(rnd.randint(0, 15)), a if d % 3 else "", say(rnd.randint(0, 4)), " ".join(b.split()[:11]), "lone" if d % 5 == 0 else ""]
        rows.append((d, rnd.choice([" ", ", ", "\n", "-"]).join(parts).replace(" ", rnd.choice([" ", "  ", "\t", "."]))))
    rows += [(None, items[0][1]), (200, None), (201, ""), (202, "..."), (203, "LONE"), (203, "LONE"), (204, items[1][1] * 3), (205, "no id here"), (206, "no id")]
    return rows, items


@pytest.mark.parametrize("pairs,places", [(1 << 19, 1 << 20), (40, 7)])
def test_marks_equal_brute_force(spark, monkeypatch, pairs, places):
    """In one block and in many, whose spans and items are united."""
    monkeypatch.setattr(leaks, "PAIRS", pairs)
    monkeypatch.setattr(leaks, "PLACES", places)
    rows, items = tables()
    docs = spark.createDataFrame([(*r, "s", 3, 4) for r in rows], "doc_id long, text string, spans string, row int, items int").repartition(3)
    bench = spark.createDataFrame([(*r, "t", 5) for r in items], "item_id long, text string, window string, size int")
    out = leaks.marks(docs, bench).collect()
    assert out[0].asDict().keys() == {"doc_id", "n_words", "spans", "items"}
    got = [(r["doc_id"], r["n_words"], sum(s["last"] - s["first"] for s in r["spans"]), sorted(r["items"])) for r in out]
    assert sorted(got, key=repr) == brute(rows, items)
    texts = {d: t for d, t in rows}
    for r in out:
        raw = (texts[r["doc_id"]] or "").encode()
        for s in r["spans"]:
            said = raw[s["start"] : s["stop"]].decode()
            assert len(WORD.findall(said.translate(LOWER))) == s["last"] - s["first"]
        assert all(x["last"] < y["first"] for x, y in zip(r["spans"], r["spans"][1:]))
    kept = leaks.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(kept.toPandas()["doc_id"].fillna(-1).tolist()) == sorted(d if d is not None else -1 for d, _, n, _ in brute(rows, items) if not n)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [tuple(r)[:2] + (list(r["spans"]), list(r["items"])) for r in leaks.marks(docs, bench.limit(0)).collect()] == [(1, 2, [], [])]
    assert leaks.marks(docs.limit(0), bench).count() == 0


def test_long_text(spark):
    """A word of a megabyte and an item that stands behind it."""
    docs = spark.createDataFrame([(1, "z" * (1 << 20) + " in the end we say so")], "doc_id long, text string")
    bench = spark.createDataFrame([(4, "we say"), (5, "z" * (1 << 20)), (6, "z" * ((1 << 20) - 1))], "item_id long, text string")
    r = leaks.marks(docs, bench).first()
    assert r["n_words"] == 7 and sorted(r["items"]) == [4, 5] and sum(s["last"] - s["first"] for s in r["spans"]) == 3
