"""Toxicity by class-conditional Kneser-Ney models.

Toxic and ordinary text each have an interpolated, absolutely discounted model: bigrams of the class,
then words of the class, then - for what is rare in a class - the continuation counts of both classes
together, which both models share. Counts are of documents, so that a passage repeated inside one
document weighs once. The sure evidence of an n-gram is log P_toxic - log P_ordinary drawn towards zero by
its standard error and a margin. A word's evidence is its sure evidence plus ``LEAK`` times its plain
log ratio, so that rare words count as well; a bigram with sure evidence adds its word's plain part
to it, and one without backs off to its word. A document's score is the mean evidence over its words,
put through a logistic curve. README has the held-out figures of this weighting and of the plain ratio.

Counting is relational and covers all rows given to learn from. All evidence is kept in a written table
that grows with the input: up to ``WHOLE`` counted n-grams it is broadcast whole, beyond that its most
frequent n-grams are broadcast and the others are joined by shuffle, with equal results. The curve is
fitted on one fold with a table that counted the other folds alone.

Defined cases: a null text is empty; an empty text has evidence 0 and takes the curve's value there;
labels that are null are left out; a doc_id labelled several times counts as toxic if any label says
so; without labelled rows of both classes every score is 0; repeated rows are scored each; an empty
table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .hashing import ALNUM, concatenate, words
from .pieces import slices
from .quality import _small, held_out

#: absolute discount, margin of evidence, weight of a word's plain log ratio, and cells of the calibration
#: histogram on either side of zero
DISCOUNT, MARGIN, LEAK, BINS = 0.75, 0.75, 0.01, 4000
#: n-grams up to which the whole table is broadcast, and documents from which a bigram without evidence is filed
WHOLE, OFTEN = 1 << 22, 1000
#: the mean evidence is drawn out near zero and compressed far from it: arcsinh(STRETCH * mean)
STRETCH = 200.0
#: fixed value: the context that marks a word's own count (word ids are odd, a text begins with context 0)
ALONE = 2


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """32-bit word ids and text number of each word, and the bigram keys (context << 32 | word; a text begins with context 0)."""
    buf, starts = concatenate(texts)
    h, doc, _, _ = words(buf, starts, ALNUM)
    w = h >> np.uint64(32) | np.uint64(1)
    before = np.concatenate([np.zeros(1, np.uint64), w[:-1]]) if len(w) else w
    if len(w):
        before[np.concatenate([[True], doc[1:] != doc[:-1]])] = 0
    return w, doc, before, before << np.uint64(32) | w


def count(rows: DataFrame) -> DataFrame:
    """(key, t, o, t4, o4) over rows (text, toxic, _fold): toxic and ordinary documents that hold each bigram and,
    with context ALONE, each word, and how many of them are in fold 4."""
    none = F.lit(0)
    parts = _gathered(rows.where("_fold <> 4")).select("key", "t", "o", none.alias("t4"), none.alias("o4"))
    parts = parts.unionByName(_gathered(rows.where("_fold = 4")).select("key", "t", "o", F.col("t").alias("t4"), F.col("o").alias("o4")))
    return parts.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("t", "o", "t4", "o4")))


def _gathered(rows: DataFrame) -> DataFrame:
    """(key, t, o) as each task has them."""

    def run(batches):
        import pyarrow as pa

        held: list[tuple[np.ndarray, np.ndarray]] = []  # keys with the class in the lowest bit, and counts

        def merged():
            key = np.concatenate([h[0] for h in held])
            order = np.argsort(key)
            key, n = key[order], np.concatenate([h[1] for h in held])[order]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            return key[start], np.add.reduceat(n, start)

        def out():
            key, n = merged()
            toxic = (key & np.uint64(1)).astype(bool)
            t, o = np.where(toxic, n, 0).astype(np.int32), np.where(toxic, 0, n).astype(np.int32)
            # a word's lowest bit carries the class here; it is always set in the key itself
            return pa.RecordBatch.from_arrays([pa.array((key | np.uint64(1)).view(np.int64)), pa.array(t), pa.array(o)], ["key", "t", "o"])

        for part in slices(batches, "text", 4 << 20):
            w, doc, _, key = _tokens(part.column("text").to_pylist())
            toxic = part.column("toxic").to_numpy()
            both = np.concatenate([key, np.uint64(ALONE << 32) | w])
            cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
            mine = [np.unique(np.concatenate([key[a:b], both[len(key) + a : len(key) + b]])) - np.uint64(1 - toxic[i]) for i, (a, b) in enumerate(zip(cut, cut[1:]))]
            key, n = np.unique(np.concatenate(mine), return_counts=True) if mine else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            held.append((key, n))
            if sum(len(h[0]) for h in held) > 4_000_000:
                yield out()
                held.clear()
        if held:
            yield out()

    return rows.select("text", "toxic").mapInArrow(run, "key long, t int, o int")


def table(counted: DataFrame) -> DataFrame | None:
    """(key, s, n), written: the evidence of every word, and of every bigram that has sure evidence or is in
    ``OFTEN`` documents (evidence 0: it backs off, but is known where texts are scored); n counts documents."""
    counted = counted.withColumn("h", F.shiftrightunsigned("key", 32)).withColumn("w", F.col("key").bitwiseAND(0xFFFFFFFF))
    single, pairs = counted.where(F.col("h") == ALONE), counted.where(F.col("h") != ALONE)
    kinds = lambda c: F.sum((F.col(c) > 0).cast("long"))
    total = single.agg(F.sum("t").alias("nt"), F.sum("o").alias("no"), kinds("t").alias("kt"), kinds("o").alias("ko")).first()
    if not total["nt"] or not total["no"]:
        return None
    follows = pairs.groupBy("w").agg(F.count("*").alias("c"))
    every = float(pairs.count())
    D, share = DISCOUNT, float(total["nt"]) / float(total["no"])

    def of_class(c: str):
        n, k = float(total["n" + c]), total["k" + c]
        return F.greatest(F.col(c) - D, F.lit(0.0)) / n + F.lit(D * k / n) * F.col("c") / every

    seen = F.log((F.col("t") + 0.5) / (F.col("o") * share + 0.5))
    doubt = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("o") + 0.5)) + MARGIN

    def sure(pt, po):
        """The model's log ratio, no further from zero than the plain ratio of the counts bears out,
        less one standard error and the margin."""
        s = F.log(pt / po)
        borne = F.when(F.signum(s) == F.signum(seen), F.least(F.abs(s), F.abs(seen))).otherwise(0.0)
        return F.signum(s) * F.greatest(borne - doubt, F.lit(0.0))

    word = single.join(follows, "w").select("w", "key", "t", "o", of_class("t").alias("pt"), of_class("o").alias("po"))
    word = common.cut(word.withColumn("plain", LEAK * F.log(F.col("pt") / F.col("po"))), "words")
    context = pairs.groupBy("h").agg(F.sum("t").alias("nt"), F.sum("o").alias("no"), kinds("t").alias("kt"), kinds("o").alias("ko"))

    def in_context(c: str):
        n, k = F.col("n" + c), F.col("k" + c)
        return F.when(n > 0, (F.greatest(F.col(c) - D, F.lit(0.0)) + D * k * F.col("p" + c)) / n).otherwise(F.col("p" + c))

    n = (F.col("t") + F.col("o")).alias("n")
    own = sure(in_context("t"), in_context("o"))
    # where the counts' own ratio stays within the doubt, the evidence is 0 whatever the model says
    grams = pairs.where(F.abs(seen) > doubt).join(word.select("w", "pt", "po", "plain"), "w").join(context, "h").select("key", F.when(own != 0, own + F.col("plain")).otherwise(0.0).cast("float").alias("s"), n)
    ones = word.select("key", (sure(F.col("pt"), F.col("po")) + F.col("plain")).cast("float").alias("s"), n)
    without = pairs.where(~(F.abs(seen) > doubt)).select("key", F.lit(0.0).cast("float").alias("s"), n)
    return common.cut(ones.unionByName(grams.unionByName(without).where((F.col("s") != 0) | (F.col("n") >= OFTEN))), "evidence")


_ROW = np.dtype([("key", "<u8"), ("s", "<f4")])


def _packed(batches):
    import pyarrow as pa

    for b in batches:
        if b.num_rows:
            out = np.zeros(b.num_rows, _ROW)
            out["key"], out["s"] = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["rows"])


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    h = (key ^ key >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def _filed(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """All of ``rows`` (key, s) with open addressing: slots, keys and evidence. An n-gram stands on its slot or,
    without a gap, behind it; no two share a place."""
    data = np.concatenate([np.frombuffer(r["rows"], _ROW) for r in rows.select("key", "s").mapInArrow(_packed, "rows binary").collect()] or [np.zeros(0, _ROW)])
    size = 1 << max(4, (2 * len(data) - 1).bit_length())
    home = _slot(data["key"], size)
    order = np.argsort(home, kind="stable")
    i = np.arange(len(data))
    at = i + np.maximum.accumulate(home[order] - i) if len(data) else i
    length = max(size, int(at[-1]) + 1 if len(at) else 0) + 1  # the last place stays free
    keys, s = np.zeros(length, np.uint64), np.zeros(length, np.float32)
    keys[at], s[at] = data["key"][order], data["s"][order]
    return size, keys, s


def _look(filed: tuple[int, np.ndarray, np.ndarray], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Evidence of each key (0 where it is not filed), and whether it is filed."""
    size, keys, s = filed
    at = _slot(key, size)
    there = keys[at]
    live = np.flatnonzero((there != key) & (there != 0))
    while len(live):
        at[live] += 1
        there = keys[at[live]]
        live = live[(there != key[live]) & (there != 0)]
    found = keys[at] == key
    return np.where(found, s[at], np.float32(0)).astype(np.float64), found


def evidence(docs: DataFrame, grams: DataFrame, keep: tuple[str, ...] = ("doc_id",), whole: int = WHOLE) -> DataFrame:
    """``keep`` and llr double, the stretched mean evidence of a text's words. Up to ``whole`` counted n-grams
    the table is broadcast; beyond it only its most frequent ones are, and the others are joined."""
    spark = docs.sparkSession
    some = grams.count() > whole
    table = spark.sparkContext.broadcast(_filed(grams.orderBy(F.desc("n"), "key").limit(whole) if some else grams))
    if some:
        mean = _joined(docs, grams, table, keep)
        return mean.select(*keep, F.asinh(STRETCH * F.col("mean")).alias("llr"))
    schema = T.StructType([*docs.select(*keep).schema, T.StructField("llr", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        for part in slices(batches, "text", 2 << 20):
            texts = part.column("text").to_pylist()
            w, doc, _, key = _tokens(texts)
            own, _ = _look(table.value, w | np.uint64(ALONE << 32))
            pair, _ = _look(table.value, key)
            n = np.bincount(doc, minlength=len(texts))
            llr = np.arcsinh(STRETCH * np.bincount(doc, np.where(pair != 0, pair, own), minlength=len(texts)) / np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([*(part.column(c).combine_chunks() for c in keep), pa.array(llr)], [*keep, "llr"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def _joined(docs: DataFrame, grams: DataFrame, table, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` and mean. What the broadcast ``table`` decides is summed where the text is read; each text's other
    n-grams are counted and meet ``grams`` by shuffle, first as bigrams, then as the words they back off to."""
    docs = docs.withColumn("_row", F.monotonically_increasing_id()) if "_row" not in docs.columns else docs
    held = T.StructType([*docs.select("_row", *keep).schema, T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("v", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        for part in slices(batches, "text", 2 << 20):
            rows = part.num_rows
            w, doc, _, key = _tokens(part.column("text").to_pylist())
            alone = w | np.uint64(ALONE << 32)
            own, known = _look(table.value, alone)
            pair, met = _look(table.value, key)
            value = np.where(pair != 0, pair, own)
            here = (pair != 0) | met & known  # decided: by the bigram, or by the word of a bigram known to have none
            # one row for each text, then one for each of its open n-grams
            n, v = np.bincount(doc[here], minlength=rows), np.bincount(doc[here], value[here], minlength=rows)
            key, doc, own, known = np.where(met, alone, key)[~here], doc[~here], own[~here], known[~here]
            order = np.lexsort((key, doc))
            key, doc, own, known = key[order], doc[order], own[order], known[order]
            start = np.flatnonzero(np.r_[len(key) > 0, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])][: len(key)])
            times = np.diff(np.r_[start, len(key)])
            which = pa.array(np.concatenate([np.arange(rows), doc[start]]))
            columns = [part.column(c).combine_chunks().take(which) for c in ("_row", *keep)]
            keys = pa.array(np.concatenate([np.zeros(rows, np.int64), key[start].view(np.int64)]), mask=np.arange(rows + len(start)) < rows)
            values = pa.array(np.concatenate([v, own[start] * times]), mask=np.concatenate([np.zeros(rows, bool), ~known[start]]))
            yield pa.RecordBatch.from_arrays([*columns, keys, pa.array(np.concatenate([n, times])), values], ["_row", *keep, "key", "n", "v"])

    single = F.shiftrightunsigned("key", 32) == ALONE
    cold = grams.where("s <> 0").select("key", "s")
    met = docs.select("_row", *keep, "text").mapInArrow(run, held).join(cold, "key", "left")
    met = met.withColumn("v", F.coalesce(F.col("n") * F.col("s").cast("double"), "v", F.when(single, F.lit(0.0)))).drop("s")
    word = F.when(F.col("v").isNull(), F.col("key").bitwiseAND(0xFFFFFFFF).bitwiseOR(F.lit(ALONE << 32)))
    met = met.withColumn("key", word).groupBy("_row", *keep, "key").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    met = met.join(cold.where(single), "key", "left").withColumn("v", F.coalesce("v", F.col("n") * F.col("s").cast("double"), F.lit(0.0)))
    return met.groupBy("_row", *keep).agg((F.sum("v") / F.greatest(F.sum("n"), F.lit(1))).alias("mean"))


def curve(rows: DataFrame) -> tuple[float, float] | None:
    """Slope and offset of the logistic curve over rows (llr, toxic), from a histogram of fixed size; None without both classes."""
    cell = F.greatest(F.least(F.round(F.col("llr") * (BINS / 8)), F.lit(BINS)), F.lit(-BINS)).cast("int")
    hist = rows.groupBy(cell.alias("c"), "toxic").agg(F.count("*").alias("n")).collect()
    if len({r["toxic"] for r in hist}) < 2:
        return None
    x = np.array([r["c"] for r in hist]) * (8 / BINS)
    y, n = np.array([r["toxic"] for r in hist], float), np.array([r["n"] for r in hist], float)
    scale = max(x.std(), 1e-6)
    x, a, b = x / scale, 1.0, 0.0
    n = n / n.sum()
    for _ in range(200):  # Newton steps, lightly damped for separable classes
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(n * (p - y) * x).sum() + 1e-4 * a, (n * (p - y)).sum()])
        v = n * np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[(v * x * x).sum() + 1e-4, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-9]])
        step = np.clip(np.linalg.solve(hess, g), -2, 2)
        a, b = a - step[0], b - step[1]
    return a / scale, b


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, llr, score: ``labels`` (doc_id, toxic) are the only rows learnt from."""
    docs = common.texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    labels = labels.withColumn("_fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5)
    docs = docs.withColumn("_row", F.monotonically_increasing_id())
    rows = docs.join(_small(labels), "doc_id")
    counted = common.cut(count(rows), "grams")
    # the curve is fitted on a fold that its table has not counted; where that fold lacks a class, on all rows
    part = table(counted.select("key", (F.col("t") - F.col("t4")).alias("t"), (F.col("o") - F.col("o4")).alias("o")).where("t + o > 0"))
    fitted = curve(evidence(rows.where("_fold = 4"), part, ("toxic",))) if part is not None else None
    grams = table(counted)
    if grams is None:
        return docs.select("doc_id", F.lit(0.0).alias("llr"), F.lit(0.0).alias("score"))
    common.discard(counted)
    slope, offset = fitted or curve(evidence(rows, grams, ("toxic",)))
    return evidence(docs, grams).withColumn("score", 1 / (1 + F.exp(-(F.col("llr") * slope + offset))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = common.read(spark, sf_dir, "labels").select("doc_id", "toxic")
    out = score(common.read(spark, sf_dir, "documents"), labels.where(~held_out()))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
