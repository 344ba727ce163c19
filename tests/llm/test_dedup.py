"""Substring dedup and near-dedup against brute force on a small table."""

from collections import Counter

import numpy as np
import pytest

from airwave.llm import sketch, suffix


def table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id < 60").collect()]
    a = rows[0][1]
    rows += [(1000, a), (1001, a + " tail"), (1002, None), (1003, ""), (1004, "ab" * 400), (1005, rows[1][1][:260] + "x" + a[-260:]), (1006, "one two"), (1007, "One two")]
    return rows, spark.createDataFrame([(d, t, "r") for d, t in rows], "doc_id long, text string, row string")


def test_suffix(spark, sf):
    rows, docs = table(spark, sf)
    got = {r["doc_id"]: r for r in suffix.strip(docs).collect()}
    raw = {d: (t or "").encode() for d, t in rows}
    seen = Counter(t[i : i + 200] for t in raw.values() for i in range(len(t) - 199))
    for d, t in raw.items():
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        assert bytes(got[d]["kept"]) == bytes(b for b, g in zip(t, gone) if not g), d


def components_of(sets, num, den):
    """The smallest id of each component by brute force over the sets of all pairs."""
    comp = {d: d for d in sets}

    def find(d):
        while comp[d] != d:
            d = comp[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def shingle_sets(rows, k):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    space = str.maketrans("\t\n\v\f\r", "     ")
    sets = {}
    for d, t in rows:
        w = [x for x in (t or "").translate(lower).translate(space).split(" ") if x]
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return sets


def test_sketch(spark, sf):
    rows, docs = table(spark, sf)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in sketch.near_duplicates(docs, 3, 85, 100).collect()}
    sets = shingle_sets(rows, 3)
    comp = components_of(sets, 85, 100)
    assert got == {d: (len(s), comp[d]) for d, s in sets.items()}


def test_twins_of_a_polynomial_hash_are_not_linked(spark):
    parity = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    twin = parity.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"x {parity} y"), (2, f"x {twin} y"), (3, f"x {parity} y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in sketch.near_duplicates(docs, 3, 85, 100).collect()} == {1: 1, 2: 2, 3: 1}


def families():
    import random

    rnd, rows = random.Random(5), []
    for family in range(4):
        base = [f"w{rnd.randrange(400)}" for _ in range(120)]
        chain = list(base)
        for i in range(25):
            star = list(base)
            for _ in range(rnd.randrange(4)):
                star[rnd.randrange(120)] = f"x{rnd.randrange(10**6)}"
            chain = list(chain)
            chain[rnd.randrange(120)] = f"y{rnd.randrange(10**6)}"
            rows += [(len(rows), " ".join(star)), (len(rows) + 1, " ".join(chain))]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("block,leaders", [(512, 8), (7, 2), (7, 1)])
def test_families_of_edits_equal_brute_force(spark, monkeypatch, block, leaders):
    """Chains and stars of edited copies, in groups that are dealt over several blocks, batches and tasks."""
    monkeypatch.setattr(sketch, "BLOCK", block)
    monkeypatch.setattr(sketch, "LEADERS", leaders)
    rows = families()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = {r["doc_id"]: r["component_id"] for r in sketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == components_of(shingle_sets(rows, 3), 85, 100)


def test_estimate_keeps_links():
    """Pairs at the threshold pass the register estimate: what is cut is hopeless."""
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(400):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 302)]
        other = [*words[:276], *(f"v{x}" for x in rng.integers(0, 10**6, 26))]
        texts += [" ".join(words), " ".join(other)]
    x, starts = sketch.shingles(texts, 3)
    regs, n = sketch.registers(x, starts), np.diff(starts).astype(float)
    a, b = regs[::2], regs[1::2]
    j = [len(np.intersect1d(x[starts[i] : starts[i + 1]], x[starts[i + 1] : starts[i + 2]])) for i in range(0, 800, 2)]
    real = np.array(j) / (n[::2] + n[1::2] - np.array(j))
    assert (np.abs(real - 0.85) < 0.02).all()
    assert (sketch.estimate(a, b, n[::2], n[1::2]) >= sketch.floor_of(0.85)).all()
    assert ((a == b).sum(1) >= sketch.equal_floor(0.85, n[::2], n[1::2])).all()


def test_keep_first_rows_and_columns(spark):
    """One row a component, by row and not by doc_id; columns of any name, null ids and empty texts pass."""
    long_ = " ".join(f"w{i}" for i in range(300_000))
    rows = [(7, "a b c d e f g"), (7, "quite another text of its own"), (1, "a b c d e f g"), (None, "a b c d e f g"), (3, None), (3, None), (4, " "), (9, "one two"), (9, "one two"), (10, long_), (11, long_ + " end")]
    docs = spark.createDataFrame([(d, t, "h", "r", "c") for d, t in rows], "doc_id long, text string, row string, component string, `all.x` string")
    kept = sketch.keep_first(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"] or 0), (r["text"] or "-")[:20]) for r in kept.collect())
    assert got == [(0, "a b c d e f g"), (1, "a b c d e f g"), (3, "-"), (3, "-"), (4, " "), (7, "quite another text o"), (9, "one two"), (10, long_[:20])]
    assert sketch.keep_first(docs.limit(0)).count() == 0
    assert sketch.near_duplicates(docs.limit(0)).count() == 0
    near = sorted((r["doc_id"] or 0, r["component_id"] or 0, bool(r["kept"])) for r in sketch.near_duplicates(docs).collect())
    assert near == [(0, 0, False), (1, 1, True), (3, 3, True), (3, 3, True), (4, 4, True), (7, 1, False), (7, 7, True), (9, 9, True), (9, 9, True), (10, 10, True), (11, 10, False)]


def removed_by_brute_force(texts, span=200):
    seen = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        out.append(bytes(b for b, g in zip(t, gone) if not g))
    return out


@pytest.mark.parametrize("local", [1000, 0])
def test_suffix_crowded_and_odd_rows(spark, monkeypatch, local):
    """One passage with many different surroundings, with and without the side-by-side refinement; a very long text,
    null ids, repeated ids and rows, columns of any name, and an empty table."""
    import random

    monkeypatch.setattr(suffix, "LOCAL", local)
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    passage, long_ = word(260), word(400_000)
    texts = [word(rnd.randint(0, 120)) + passage[rnd.randint(0, 40) : 260 - rnd.randint(0, 40)] + word(rnd.randint(0, 120)) for _ in range(60)]
    texts += [long_, long_[1000:1500] + word(50), "ab" * 600, None, "", texts[0], word(199), "é" * 150]
    ids = [*range(60), 60, 61, None, 63, 63, 0, 66, 67]
    docs = spark.createDataFrame([(d, t, "r", "s", i) for i, (d, t) in enumerate(zip(ids, texts))], "doc_id long, text string, row string, spans string, `a.b` int")
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, bytes(r["kept"])) for r in suffix.strip(docs).collect())
    kept = removed_by_brute_force([(t or "").encode() for t in texts])
    assert got == sorted((d is not None, d or 0, k) for d, k in zip(ids, kept))
    short = suffix.shorten(docs)
    assert short.columns == docs.columns
    assert {r["a.b"]: r["text"] for r in short.collect()} == {i: None if t is None else k.decode(errors="ignore") for i, (t, k) in enumerate(zip(texts, kept))}
    assert suffix.strip(docs.limit(0)).count() == 0 and suffix.shorten(docs.limit(0)).count() == 0
