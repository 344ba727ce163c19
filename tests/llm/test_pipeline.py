"""Each stage of the corpus pipeline against a brute-force version, on what its predecessor kept."""

import struct
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from airwave.llm import common, packing, quality


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def near_survivors(texts):
    """The smallest id of each component of links at 0.8 on five-word shingles; empty texts stay alone."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    space = str.maketrans("\t\n\v\f\r", "     ")
    sets = {}
    for d, t in texts.items():
        w = [x for x in t.translate(lower).translate(space).split(" ") if x]
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    comp = {d: d for d in sets}

    def find(d):
        while comp[d] != d:
            d = comp[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {d for d in sets if find(d) == d}


def without_repeats(texts, span=200):
    raw = {d: t.encode() for d, t in texts.items()}
    seen = Counter(t[i : i + span] for t in raw.values() for i in range(len(t) - span + 1))
    out = {}
    for d, t in raw.items():
        gone = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        out[d] = bytes(b for b, g in zip(t, gone) if not g).decode(errors="ignore")
    return out


def test_stages(spark, sf, tmp_path):
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 110 and length(text) < 12000")
    first = docs.where("length(text) between 800 and 4000").orderBy("doc_id").limit(6)
    copies = first.withColumn("doc_id", F.col("doc_id") + 10_000)
    near = first.withColumn("doc_id", F.col("doc_id") + 20_000).withColumn("text", F.concat("text", F.lit(" tail of its own")))
    shared = first.withColumn("doc_id", F.col("doc_id") + 30_000).withColumn("text", F.concat(F.lit("some other words stand before "), F.col("text").substr(1, 300)))
    where = str(tmp_path)
    docs.unionByName(copies).unionByName(near).unionByName(shared).write.parquet(f"{where}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{where}/labels.parquet")
    frame, kept = common.read(spark, where, "documents"), []
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES:
        frame = common.cut(stage(spark, frame, where), name)
        kept.append(frame)
    start, good, exact, alone, short = rows_of(common.read(spark, where, "documents")), *map(rows_of, kept[:4])
    assert [f.columns for f in kept[:4]] == [columns] * 4

    before = common.read(spark, where, "documents")
    model = quality.train(before, quality.ratings(common.read(spark, where, "labels")).where(~quality.held_out()), quality.GRADES)
    passed = {r["doc_id"] for r in quality.score(before, model, quality.GRADES).where("tails[0] >= 0.5").collect()}
    assert good.keys() == passed and 60 < len(good) <= len(start)
    assert all(good[d] == start[d] for d in good)

    last = {}
    for d, r in good.items():
        last[r["text"] or ""] = max(d, last.get(r["text"] or "", d))
    assert exact.keys() == set(last.values()) and len(exact) < len(good)

    assert alone.keys() == near_survivors({d: r["text"] or "" for d, r in exact.items()})
    assert len(alone) < len(exact)

    want = without_repeats({d: r["text"] or "" for d, r in alone.items()})
    assert {d: r["text"] or "" for d, r in short.items()} == want
    assert any(want[d] != (r["text"] or "") for d, r in alone.items())

    tok = Tokenizer.from_file(packing.tokenizer_path())
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in kept[4].collect():
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == short.keys()
    for d, mine in pieces.items():
        ids = [*tok.encode(want[d], add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(mine, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)
    for spans in windows.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 2048
    assert corpus_pipeline.run(spark, where).count() == sum(map(len, pieces.values()))
