"""Exact dedup, chat, embeddings, quality and toxicity on small tables."""

import hashlib
import math
import random
import re

import numpy as np

from airwave.llm import chat, components, embeddings, exact, quality, toxicity


def docs(spark, rows):
    return spark.createDataFrame([(a, b, "h") for a, b in rows], "doc_id long, text string, _h string")


def test_exact(spark, tmp_path):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (None, "a"), (6, "é" * 5000)]
    d = docs(spark, rows)
    index = exact.build(d, str(tmp_path / "i"), capacity=1)
    got = sorted(((r["doc_id"] or 0), r["keep_id"], r["group_size"], r["kept"]) for r in exact.lookup(d, index).collect())
    assert got == [(0, 2, 3, False), (1, 2, 3, False), (2, 2, 3, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 2, False), (5, 5, 2, True), (6, 6, 1, True)]
    kept = exact.drop_copies(d, index)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 6]
    assert exact.lookup(docs(spark, []), exact.build(docs(spark, []), str(tmp_path / "e"))).count() == 0
    clash = d.selectExpr("doc_id", "text", "_h as hash", "_h as bucket", "_h as `whole.nth`", "_h as slot")
    kept = exact.drop_copies(clash, exact.build(clash, str(tmp_path / "c"), capacity=2))
    assert kept.columns == clash.columns and kept.count() == 4


def test_exact_chains_compare_bytes():
    """Different texts on one hash are different classes, equal ones of several slices one class."""
    import pyarrow as pa

    rows = [(0, 5, "a", 1, 1), (0, 5, "b", 7, 2), (0, 5, "a", None, 3), (1, 9, "a", None, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["slot", "hash", "text", "keep_id", "group_size"])
    out = [r for b in exact._chained(iter([batch.slice(0, 2), batch.slice(2)])) for r in b.to_pylist()]
    digest = lambda t: hashlib.sha256(t).hexdigest()
    got = [(r["hash"], r["chain"], r["text_sha256"], r["keep_id"], r["group_size"]) for r in out]
    assert got == [(5, 0, digest(b"a"), 1, 4), (5, 1, digest(b"b"), 7, 2), (9, 0, digest(b"a"), None, 1)]


def test_exact_index_is_filed_by_bucket(spark, sf, tmp_path):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    index = exact.build(d, str(tmp_path / "b"), capacity=60)
    sizes = [r["count"] for r in index.classes.groupBy("bucket").count().collect()]
    assert len(sizes) > 8 and max(sizes) <= 60
    assert len(set(index.slots)) >= len(sizes)
    wrong = index._replace(slots=[-1] * len(index.slots))
    assert exact.lookup(d, wrong).count() == 0 and exact.lookup(d, index).count() == d.count()


def test_directory_covers_every_slot_once():
    rnd = random.Random(3)
    counts = {rnd.randrange(256): rnd.randint(1, 40) for _ in range(60)}
    slots = exact.directory(counts, 50, 8)
    assert exact.directory({}, 50, 0) == [0]
    span = 256 // len(slots)
    load = {}
    for i, b in enumerate(slots):
        load[b] = load.get(b, 0) + sum(counts.get(i * span + k, 0) for k in range(span))
    assert sum(load.values()) == sum(counts.values())
    assert all(n <= 50 or slots.count(b) == 1 for b, n in load.items())


def test_chat(spark, sf):
    texts = ["</s>[INST] ok [/INST]", "\\", "a\\[b", "", " x ", "<<y>>", "日本 </s>"]
    turns = [(r, t) for t in texts for r in ("user", "assistant", "system", "", "we>>ird<")]
    made, spans = chat.render(turns)
    assert chat.parse(made) == turns
    assert [chat.unescape(made[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "dup"), (2, 0, None, "x"), (None, 0, "user", "n")]
    got = {r["tree"]: r for r in chat.read_back(chat.format_paths(chat.linear(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 3
    assert got[2]["turns_sha256"] == hashlib.sha256(b"\nx\n").hexdigest()
    assert chat.format_paths(chat.linear(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_chat_null_conversation(spark, tmp_path):
    """Rows without a conv_id are one conversation, which stays without one."""
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (7, 0, "user", "c")]
    spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, tree string, node int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.query(spark, str(tmp_path)).collect()}
    assert got == {None: (2, 1), 7: (1, 0), -1: (2, 21)}


def test_chat_branches(spark):
    rnd = random.Random(1)
    nodes, parent = [], {}
    for tree in range(3):
        for n in range(60):
            parent[tree, n] = None if n == 0 else rnd.randrange(max(0, n - 4), n)
            nodes.append((tree, n, parent[tree, n], float(rnd.randint(0, 9))))
    nodes += [(9, 1, 2, 1.0), (9, 2, 1, 1.0), (9, 3, None, 1.0)]  # a cycle and a lone root
    parent |= {(9, 3): None}
    score = {(t, n): s for t, n, _, s in nodes}
    got = {}
    for r in chat.branches(spark.createDataFrame(nodes, "tree long, node long, parent long, score double"), 2).collect():
        got.setdefault((r["tree"], r["leaf"]), []).append((r["depth"], r["node"], r["branch_score"]))
    for tree in (0, 1, 2, 9):
        leaves = []
        for t, n in parent:
            if t == tree and not any(p == n for (u, _), p in parent.items() if u == t):
                path, at = [], n
                while at is not None:
                    path.append(at)
                    at = parent[t, at]
                leaves.append((-sum(score[t, x] for x in path), n, path[::-1]))
        for s, leaf, path in sorted(leaves)[:2]:
            assert [(d, n) for d, n, _ in sorted(got.pop((tree, leaf)))] == list(enumerate(path, 1))
    assert not got


def brute(vectors, least=0.98):
    n = len(vectors)
    ok = [v is not None and lab is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, lab in vectors]
    links = [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and vectors[i][2] == vectors[j][2] and len(vectors[i][1]) == len(vectors[j][1]):
                a, b = np.float64(np.float32(vectors[i][1])), np.float64(np.float32(vectors[j][1]))
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= least:
                    links[i].add(j)
                    links[j].add(i)
    comp = list(range(n))
    moved = True
    while moved:
        moved = False
        for i in range(n):
            c = min([comp[i], *(comp[j] for j in links[i])], key=lambda x: vectors[x][0])
            moved |= c != comp[i]
            comp[i] = c
    return {vectors[i][0]: (len(links[i]), vectors[comp[i]][0]) for i in range(n)}


def test_embeddings(spark, sf):
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rnd = random.Random(2)
    for k in range(60):  # near and exact copies
        v = rows[k][1]
        rows.append((1000 + k, [x + rnd.gauss(0, 0.012) for x in v], rows[k][2]))
        rows.append((2000 + k, list(v), rows[k][2] if k % 2 else None))
    rows += [(5000, None, 1), (5001, [], 1), (5002, [0.0] * 64, 1), (5003, [float("nan")] + [1.0] * 63, 1), (5004, [None] * 64, 1), (5005, [1.0, 2.0], 1), (5006, [2.0, 4.0], 1), (5007, [float("inf")] * 64, 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    total = sum(n for n, _ in want.values())
    assert sum(n for n, _ in got.values()) >= 0.97 * total and total > 150
    assert all(got[k][0] <= want[k][0] for k in want)
    assert sum(got[k] == want[k] for k in want) >= 0.97 * len(want)


def test_candidates_count_shared_pivots(monkeypatch):
    """Counts from postings against sets, for every first shared pivot; each pair once over all lists."""
    monkeypatch.setattr(embeddings, "CELLS", 64)
    rng = np.random.default_rng(1)
    perms = [rng.permutation(30)[: rng.integers(4, 8)] for _ in range(40)]
    want = {(i, j) for i in range(40) for j in range(40) if len({*perms[i]} & {*perms[j]}) >= 3}
    got = []
    for pivot in range(30):
        mine = [k for k in range(40) if pivot in perms[k]]
        if mine:
            for i, j in embeddings.candidates([perms[k] for k in mine], [perms[k] for k in mine], pivot, 3):
                got += [(mine[a], mine[b]) for a, b in zip(i, j)]
    assert len(got) == len(set(got)) and set(got) == want


def test_embedding_edge_rows(spark):
    """Null ids, repeated ids, clashing columns and an empty table."""
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (None, [1.0, 0.0], 1), (3, [0.0, 1.0], None)]
    d = spark.createDataFrame([(*r, "c", 7) for r in rows], "vec_id long, embedding array<float>, label int, rep string, weight int")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in embeddings.near_duplicates(d).collect())
    assert got == [(0, 0, 0), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]
    assert embeddings.near_duplicates(d.limit(0)).count() == 0


def test_embeddings_that_share_a_vec_id(spark):
    """Each vector has its own links, whatever its id."""
    rows = [(1, [0.0, 1.0], 1), (1, [1.0, 0.0], 1), (2, [0.01, 1.0], 1), (3, [1.0, 0.01], 1), (4, [1.0, -0.01], 1), (5, [1.0, 1.0], 1)]
    got = sorted(tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False), (5, 0, 5, True)]


def test_embedding_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(3, 16))
    rows = [(i, (base[i % 3] + rng.normal(size=16) * 0.05).tolist(), i % 2) for i in range(150)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == brute(rows)


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(50)]
    comp = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in comp:
        for a, b in edges:
            if a != b:
                comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == comp
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.query(spark, sf).join(labels, "doc_id").where("held_out").collect()
    right = sum(r["kept"] == (r["quality"] == 1) for r in got)
    assert right >= 0.93 * len(got) and len(got) > 50
    d = spark.read.parquet(f"{sf}/documents.parquet")
    kept = quality.filtered(spark, d, sf)
    assert kept.columns == d.columns
    odd = docs(spark, [(1, None), (None, ""), (2, "x"), (2, "x"), (3, "!!! " * 4000)])
    model = quality.train(odd, spark.createDataFrame([], "doc_id long, grade int"), 3)
    assert model is None
    scores = quality.score(odd, model, 3)
    assert scores.count() == 5
    assert quality.select(odd, scores, scores["expected_grade"] >= 0).count() == 5
    assert quality.keep_scored(odd, model).count() == 5
    assert quality.score(docs(spark, []), None, 3).count() == 0


def test_ordinal_fit_orders_thresholds():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 4, 400)
    d = np.repeat(np.arange(400), 2)
    c = np.stack([grades, rng.integers(4, 9, 400)], 1).ravel()
    w, cut = quality.fit(d, c, np.ones(800), grades, 4, buckets=16)
    assert (np.diff(cut) > 0).all() and w[0] < w[1] < w[2] < w[3]


def ordinal_objective(w, cut, x, grades, decay):
    """Mean log probability of the grades under cumulative links, written out, less the decay."""
    total = 0.0
    for row, g in zip(x, grades):
        f = sum(a * b for a, b in zip(row, w))
        tail = [1.0, *(1 / (1 + math.exp(c - f)) for c in cut), 0.0]
        total += math.log(tail[g] - tail[g + 1])
    return total / len(grades) - decay / 2 * sum(a * a for a in w)


def test_ordinal_fit_equals_a_direct_maximiser():
    """The fitted likelihood against a plain search by coordinates on a small sample."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 3))
    grades = np.clip(np.round(x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=60) * 0.8 + 1), 0, 2).astype(int)
    d, c = np.repeat(np.arange(60), 3), np.tile(np.arange(3), 60)
    w, cut = quality.fit(d, c, x.ravel(), grades, 3, buckets=3, rounds=600, decay=1e-3)
    got = ordinal_objective(w, cut, x, grades, 1e-3)
    at, step = [0.0, 0.0, 0.0, -1.0, 1.0], 1.0
    best = ordinal_objective(at[:3], at[3:], x, grades, 1e-3)
    while step > 1e-4:
        moved = False
        for i in range(5):
            for sign in (step, -step):
                to = [*at[:i], at[i] + sign, *at[i + 1 :]]
                if to[3] < to[4] and (v := ordinal_objective(to[:3], to[3:], x, grades, 1e-3)) > best + 1e-12:
                    at, best, moved = to, v, True
        step = step if moved else step / 2
    assert abs(got - best) < 2e-3
    assert np.allclose([*w, *cut], at, atol=0.15)


def test_quality_scores_equal_the_written_out_model(spark):
    """Tails of every text from weights and thresholds, occurrence by occurrence."""
    texts = ["Good day to you all", "", "!!! !!! 123 aaa aaa", "x " * 500, "Über 12 Straße."]
    rng = np.random.default_rng(2)
    model = (rng.normal(size=quality.BUCKETS).astype(np.float32), np.array([-0.5, 0.7]))
    got = {r["doc_id"]: r for r in quality.score(docs(spark, [*enumerate(texts)]), model, 3).collect()}
    for i, t in enumerate(texts):
        f = sum(v * float(model[0][c]) for _, c, v in zip(*quality.features([t])))
        tails = [1 / (1 + math.exp(c - f)) for c in model[1]]
        assert np.allclose(got[i]["tails"], tails, atol=1e-5) and abs(got[i]["expected_grade"] - sum(tails)) < 1e-5


def test_toxicity(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.query(spark, sf).join(labels, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in got)
    assert right >= 0.94 * len(got)
    odd = docs(spark, [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "y " * 9000)])
    none = toxicity.score(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.count() == 5 and {r["score"] for r in none.collect()} == {0.0}
    assert toxicity.score(docs(spark, []), labels.select("doc_id", "toxic")).count() == 0


def test_toxicity_joined_table_equals_broadcast(spark, sf):
    from pyspark.sql import functions as F

    from airwave.llm import common

    labelled = common.texts(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    grams = toxicity.table(common.cut(toxicity.count(labelled.where("doc_id % 2 = 0").withColumn("toxic", F.col("toxic").cast("int")).withColumn("_fold", F.lit(1)))))
    odd = docs(spark, [(-1, ""), (-2, "x"), (-3, "x x x")]).drop("_h")
    every = common.texts(spark.read.parquet(f"{sf}/documents.parquet")).unionByName(odd).unionByName(odd)
    want = sorted((r["doc_id"], r["llr"]) for r in toxicity.evidence(every, grams).collect())
    assert len({x for _, x in want}) > 100
    for whole in (1, 1000):
        got = sorted((r["doc_id"], r["llr"]) for r in toxicity.evidence(every, grams, whole=whole).collect())
        assert [d for d, _ in got] == [d for d, _ in want]
        assert np.allclose([x for _, x in got], [x for _, x in want], rtol=0, atol=1e-9)


def test_toxicity_files_every_ngram(spark):
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(1, 1 << 62, 30_000)) | 1
    rows = spark.createDataFrame([(int(k), float(i + 1)) for i, k in enumerate(keys)], "key long, s float")
    filed = toxicity._filed(rows)
    value, found = toxicity._look(filed, keys.view(np.uint64))
    assert found.all() and (value == np.arange(len(keys)) + 1).all()
    assert not toxicity._look(filed, (keys + 1).view(np.uint64))[1].any()


def test_toxicity_counts_rare_expressions_and_every_fold(spark):
    rows, labels = [], []
    for i in range(1, 201):
        toxic = i % 4 == 0
        rows.append((i, "the day was " + ("vile" if toxic else "calm") + " again" + (f" rare{i % 24}" if toxic else "")))
        labels.append((i, int(toxic)))
    rows += [(1001, "rare4 rare4"), (1002, "")]
    got = {r["doc_id"]: r["llr"] for r in toxicity.score(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert got[1001] > got[1002]  # in fewer than ten toxic documents
    import zlib

    four = next(i for i in range(1, 201) if zlib.crc32(str(i).encode()) % 5 == 4 and i % 4 == 0)
    rows = [(i, t + (" onlyhere" if i == four else "")) for i, t in rows if i <= 200] + [(1001, "onlyhere"), (1002, "")]
    got = {r["doc_id"]: r["llr"] for r in toxicity.score(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert got[1001] > got[1002]


def plain_model(learn, docs):
    """The score's evidence in plain Python: (doc_id, text, toxic) learnt from, texts scored."""
    words = lambda t: [w.lower() for w in re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", t)]
    pair, single = {}, {}
    for _, t, toxic in learn:
        ws = words(t)
        for table, found in ((single, set(ws)), (pair, set(zip([None, *ws], ws)))):
            for g in found:
                table.setdefault(g, [0, 0])[0 if toxic else 1] += 1
    n = [sum(c[i] for c in single.values()) for i in (0, 1)]
    k = [sum(c[i] > 0 for c in single.values()) for i in (0, 1)]
    follows = {}
    for _, w in pair:
        follows[w] = follows.get(w, 0) + 1
    D, context = toxicity.DISCOUNT, {}
    for (h, _), c in pair.items():
        x = context.setdefault(h, [[0, 0], [0, 0]])
        for i in (0, 1):
            x[0][i] += c[i]
            x[1][i] += c[i] > 0

    def sure(c, p):
        s, seen = math.log(p[0] / p[1]), math.log((c[0] + 0.5) / (c[1] * n[0] / n[1] + 0.5))
        doubt = math.sqrt(1 / (c[0] + 0.5) + 1 / (c[1] + 0.5)) + toxicity.MARGIN
        borne = min(abs(s), abs(seen)) if s * seen > 0 else 0.0
        return math.copysign(max(borne - doubt, 0.0), s) if borne > doubt else 0.0, abs(seen) > doubt

    p1 = {w: [max(c[i] - D, 0) / n[i] + D * k[i] / n[i] * follows[w] / len(pair) for i in (0, 1)] for w, c in single.items()}
    plain = {w: toxicity.LEAK * math.log(p[0] / p[1]) for w, p in p1.items()}
    one = {w: sure(single[w], p1[w])[0] + plain[w] for w in single}
    two = {}
    for (h, w), c in pair.items():
        size, kinds = context[h]
        p = [(max(c[i] - D, 0) + D * kinds[i] * p1[w][i]) / size[i] if size[i] else p1[w][i] for i in (0, 1)]
        s, clear = sure(c, p)
        if clear and s:
            two[h, w] = s + plain[w]
    out = {}
    for d, t, *_ in docs:
        ws = words(t)
        total = sum(two.get((h, w)) or one.get(w, 0.0) for h, w in zip([None, *ws], ws))
        out[d] = math.asinh(toxicity.STRETCH * total / len(ws)) if ws else 0.0
    return out


def test_toxicity_equals_the_written_out_model(spark):
    """Counts, shared continuation counts, discounts and evidence against plain Python."""
    from pyspark.sql import functions as F

    from airwave.llm import common

    rnd = random.Random(11)
    common_, bad = [f"w{i}" for i in range(25)], ["vile", "Rotten", "über"]
    learn = []
    for i in range(240):
        toxic = int(i % 4 == 0)
        ws = [rnd.choice(common_) for _ in range(rnd.randint(1, 12))] + [rnd.choice(bad) for _ in range(rnd.randint(1, 2) if toxic else rnd.random() < 0.03)]
        rnd.shuffle(ws)
        learn.append((i, " ".join(ws), toxic))
    docs_ = learn + [(900, "", 0), (901, "unseen vile w1!", 0), (902, "vile rotten", 0)]
    rows = spark.createDataFrame(learn, "doc_id long, text string, toxic int").withColumn("_fold", F.col("doc_id") % 5)
    grams = toxicity.table(common.cut(toxicity.count(rows)).select("key", "t", "o"))
    got = {r["doc_id"]: r["llr"] for r in toxicity.evidence(spark.createDataFrame([d[:2] for d in docs_], "doc_id long, text string"), grams).collect()}
    want = plain_model(learn, docs_)
    assert got.keys() == want.keys()
    assert all(abs(got[d] - want[d]) < 1e-4 for d in want), [(d, got[d], want[d]) for d in want if abs(got[d] - want[d]) > 1e-4][:5]
    assert want[902] > want[900] and len({round(x, 6) for x in want.values()}) > 50


def test_chat_edge_rows(spark):
    """Null trees, clashing columns, a very long text, repeated turns and an empty table."""
    long_ = "</s>" * 300_000
    rows = [(1, 0, "user", long_), (1, 1, "assistant", "ok"), (1, 1, "assistant", "ok"), (2, 0, "assistant", None), (None, 5, "user", "lost")]
    d = spark.createDataFrame([(*r, "c", "c") for r in rows], "conv_id long, turn long, role string, text string, tree string, node string")
    got = {r["tree"]: r for r in chat.read_back(chat.format_paths(chat.linear(d))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 4 and got[1]["formatted_chars"] > len(long_)
    assert got[2]["n_turns"] == 1 and got[2]["loss_chars"] == 0


def test_quality_select_keeps_columns(spark):
    d = spark.createDataFrame([(1, "a b", "k", "r", 1.0), (2, "!!", "k", "r", 2.0), (1, "a b", "k", "r", 3.0), (None, None, "k", "r", 4.0)], "doc_id long, text string, _key string, row_key string, tails double")
    scores = quality.score(d, None, 3)
    kept = quality.select(d, scores, scores["expected_grade"] >= 0)
    assert kept.columns == d.columns and kept.count() == 4
    assert quality.select(d, scores, scores["doc_id"] == 1).count() == 2
    assert quality.keep_scored(d, None).columns == d.columns
