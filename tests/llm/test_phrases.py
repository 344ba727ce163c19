"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from airwave.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest, top, share=80):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    longer = Counter()
    for (lang, g), c in f.items():
        if c >= least:
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    longer[lang, g[i : i + m]] = max(longer[lang, g[i : i + m]], c)
    out = {}
    for (lang, g), a in f.items():
        if a >= least and len(g) > 1 and 100 * longer[lang, g] < share * a or (a >= least and len(g) > 1 and not longer[lang, g]):
            score, _, left, right = min((2000000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
            out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), left, right))
    got = []
    for lang, those in out.items():
        for rank, (score, a, g, left, right) in enumerate(sorted(those)[:top], 1):
            got.append((lang, rank, g.decode(), -a, left, right, n[lang], -score))
    return sorted(got)


def some_rows():
    rnd = random.Random(11)
    words = ["the", "The", "of", "é", "日本", "x-y", "a\x00b", "\x0e", "z" * 9, "z" * 10] + [f"w{i}" for i in range(30)]
    rows = [(i, "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", " ", ", ", ".", "\n", "\x0b"]) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "de", "und", None, ""])) for i in range(300)]
    rows += [(400 + i, "one fixed line of words that all repeat, and its tail goes on and on and on", "en") for i in range(40)]
    return rows + [(500, None, "en"), (501, "", None), (502, "lone", "one"), (503, "q " * 3000, "qq"), (504, "y" * 100_000, "en")]


@pytest.mark.parametrize("whole,small,held,longest", [(1 << 22, 1 << 12, 6 << 20, 4), (0, 1, 500, 4), (60, 4, 10, 3), (1 << 22, 2, 100, 2)])
def test_collocations_equal_plain_counting(spark, monkeypatch, whole, small, held, longest):
    """Filtered early and not, partitions sorted down to one pointer and finished plainly, in many sendings."""
    for name, value in (("WHOLE", whole), ("SMALL", small), ("HELD", held), ("RANKED", 50)):
        monkeypatch.setattr(phrases, name, value)
    rows = some_rows()
    d = spark.createDataFrame([(*r, "k", 1, "w") for r in rows], "doc_id long, text string, lang string, key string, n int, words string").repartition(3)
    got = phrases.collocations(d, least=6, longest=longest, top=40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 6, longest, 40)
    assert phrases.collocations(d.limit(0)).count() == 0


def test_words_that_share_a_key_take_another_seed(spark, monkeypatch):
    rows = some_rows()[:60]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    plain, seeds = phrases.read_words, []

    def weak(part, seed):
        key, *more = plain(part, seed)
        return key & np.uint64(7 if seed == 0 else 2**64 - 1), *more

    counted = phrases.vocabulary
    monkeypatch.setattr(phrases, "read_words", weak)
    monkeypatch.setattr(phrases, "vocabulary", lambda rows, seed: seeds.append(seed) or counted(rows, seed))
    found, words = phrases.frequent(d, 3, 3)
    assert words.groupBy("key").count().where("count > 1").count() == 0 and found.count() > 5 and seeds == [0, 1]


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**14
    p = spark.createDataFrame([([1], 10**15), ([2], big + 1), ([1, 2], big)], "words array<long>, f long")
    assert [(r["l"], r["r"], r["score"]) for r in phrases.scored(p).collect()] == [(10**15, big + 1, 2000000 * big // (10**15 + big + 1))]


@pytest.mark.parametrize("small", [1, 64])
def test_quicksort_sizes_are_counts(monkeypatch, small):
    monkeypatch.setattr(phrases, "SMALL", small)
    rng = np.random.default_rng(3)
    end = np.uint64(2**32 - 1)
    columns = [rng.integers(0, 6, 500).astype(np.uint64) for _ in range(3)]
    columns[2][rng.random(500) < 0.3] = end
    weight = rng.integers(1, 5, 500)
    want = Counter()
    for row, w in zip(zip(*(c.tolist() for c in columns)), weight.tolist()):
        for d in (1, 2, 3):
            if row[d - 1] != int(end):
                want[row[:d]] += w
    got = {}
    for depth, at, count in phrases.quicksort(columns, weight, 20, end, 1):
        for i, c in zip(at.tolist(), count.tolist()):
            key = tuple(int(x[i]) for x in columns[:depth])
            assert key not in got
            got[key] = c
    assert got == {k: v for k, v in want.items() if v >= 20}


def test_no_task_has_two_python_workers(spark, monkeypatch):
    """A pass over rows that another Python pass made would run in a worker of its own, and executors keep both."""
    frame, plans = type(spark.range(0)), []
    for owner, name in ((frame, "collect"), (frame, "count"), (phrases.common, "cut")):
        plain = getattr(owner, name)
        monkeypatch.setattr(owner, name, lambda df, *a, plain=plain: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or plain(df, *a))
    d = spark.createDataFrame(some_rows(), "doc_id long, text string, lang string")
    phrases.frequent(d, 6, 4)
    stages = [stage for plan in plans for stage in re.split(r"Exchange|Repartition", plan)]
    assert max(s.count("MapInArrow") for s in stages) == 1


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_suffixes_are_sent_in_bounded_lots(monkeypatch, longest):
    """Every suffix goes once, in lots that hold no more than they may."""
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 50, (200_000, longest)).astype(np.uint32)
    want = Counter(map(tuple, rows.tolist()))
    monkeypatch.setattr(phrases, "SENT", 10_000)
    columns = [rows[:, i].copy() for i in range(longest)]
    columns, n = phrases.distinct(columns, True)
    got, biggest = Counter(), 0
    for lot in phrases.together(phrases.route(columns, n, 2, 300, np.dtype("<u4"))):
        biggest = max(biggest, sum(len(blob) for _, _, blob in lot) if len(lot) > 1 else 0)
        for _, m, blob in lot:
            *words, f = np.frombuffer(blob, "<u4").reshape(longest + 1, m).tolist()
            got.update(dict(zip(zip(*words), f)))
    assert got == want and biggest <= 10_000


def test_distinct_uses_its_columns_up():
    columns = [np.arange(8, dtype=np.uint32) for _ in range(4)]
    assert len(phrases.distinct(columns, True)[0]) == 4 and not columns
