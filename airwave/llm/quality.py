"""Quality classifier: ordinal cumulative-link regression on hashed text.

Grades 0..K-1 share one weight vector over hashed features; ordered thresholds b_1 < ... < b_{K-1}
give P(grade >= k) = sigmoid(f(text) - b_k). The expected grade is the sum of these tails, and a
tail probability selects documents. Features are case-folded words, their shapes (runs of letters,
digits and marks), immediate repeats and a few shares of the whole text.

The fit takes at most ``SAMPLE`` labelled rows, chosen by the smallest hash of doc_id, so that what
reaches the driver has a fixed bound; scoring covers every row and whole texts.

Defined cases: a null text is empty and is scored by the thresholds and shares alone; labels without
a grade are left out; a doc_id labelled several times takes its lowest grade; without usable labels
every document gets even odds and stays; extra columns of documents pass through ``select`` and never
reach a feature.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .hashing import ALNUM, SPACE, concatenate, mix, words
from .pieces import slices

#: labelled rows of the fit at most, hash buckets, labels rows up to which they are broadcast
SAMPLE, BUCKETS, BROADCAST_ROWS = 6_000, 1 << 18, 2_000_000

#: byte classes of a word's shape: other mark, lower case or other letter, upper case, digit
_SHAPE = np.zeros(256, np.uint64)
_SHAPE[[*range(97, 123), *range(128, 256)]] = 1
_SHAPE[65:91] = 2
_SHAPE[48:58] = 3
_MARK = np.arange(256, dtype=np.uint64) + np.uint64(10)


def features(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, value) of every occurrence; the values of a document's words sum to one per family."""
    n = len(texts)
    buf, starts = concatenate(texts)
    h, doc, first, last = words(buf, starts, ~SPACE)
    count = np.bincount(doc, minlength=n)
    share = 1.0 / np.maximum(count, 1)[doc]
    # a word's shape: its first and last byte class and its length class
    kind = np.where(_SHAPE > 0, _SHAPE, _MARK)
    shape = kind[buf[first]] * np.uint64(300) + kind[buf[last - 1]] if len(first) else np.zeros(0, np.uint64)
    shape = mix(shape + np.minimum(last - first, 16).astype(np.uint64) * np.uint64(1 << 20) + np.uint64(1 << 40))
    tail = mix(kind[buf[last - 1]] + np.uint64(1 << 41)) if len(first) else np.zeros(0, np.uint64)
    again = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1])) + 1
    alnum = np.concatenate([[0], np.cumsum(ALNUM[buf])])
    upper = np.concatenate([[0], np.cumsum(_SHAPE[buf] == 2)])
    size = np.maximum(np.diff(starts) - 1, 1)
    letters = np.diff(alnum[starts]) / size
    capitals = np.diff(upper[starts]) / size
    repeats = np.bincount(doc[again], minlength=n) / np.maximum(count, 1)
    levels = np.stack([np.minimum(x * 20, 19).astype(np.uint64) + np.uint64((1 << 42) + 100 * i) for i, x in enumerate((letters, capitals, repeats))])
    levels = np.concatenate([levels, (np.log2(count + 1).astype(np.uint64) + np.uint64((1 << 42) + 900))[None]])
    ids = np.concatenate([h, shape, tail, mix(levels.ravel())])
    docs = np.concatenate([doc, doc, doc, np.tile(np.arange(n), len(levels))])
    vals = np.concatenate([4 * share, 4 * share, 4 * share, np.full(levels.size, 0.25)])
    return docs, (ids % np.uint64(buckets)).astype(np.int64), vals


def fit(docs: np.ndarray, cols: np.ndarray, vals: np.ndarray, grades: np.ndarray, k: int, buckets: int = BUCKETS, rounds: int = 120, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that maximise the mean log of P(grade) = P(>= grade) - P(>= grade + 1) under
    cumulative links, less ``decay`` / 2 times the squared weights (Adam on the full sample)."""
    n = len(grades)
    w, cut = np.zeros(buckets), np.linspace(-1, 1, k - 1) if k > 2 else np.zeros(1)
    used, cols = np.unique(cols, return_inverse=True)
    x, m, v = np.concatenate([np.zeros(len(used)), cut[:1], np.log(np.maximum(np.diff(cut), 1e-3))]), 0.0, 0.0
    row, low, high = np.arange(n), np.maximum(grades - 1, 0), np.minimum(grades, k - 2)
    has_low, has_high = grades > 0, grades < k - 1
    for t in range(1, rounds + 1):
        own = x[: len(used)]
        b = np.cumsum(np.concatenate([x[len(used) : len(used) + 1], np.exp(x[len(used) + 1 :])]))
        f = np.bincount(docs, vals * own[cols], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(f[:, None] - b, -30, 30)))
        # P(grade) is the tail at its own threshold less the tail at the next; log P rises by 1 - p - q with the text's value
        up, down = np.where(has_low, p[row, low], 1.0), np.where(has_high, p[row, high], 0.0)
        slope, width = 1 - up - down, np.maximum(up - down, 1e-9)
        g_own = np.bincount(cols, vals * (-slope / n)[docs], minlength=len(used)) + decay * own
        g_b = np.bincount(low, np.where(has_low, up * (1 - up) / width, 0.0), minlength=k - 1)
        g_b = (g_b - np.bincount(high, np.where(has_high, down * (1 - down) / width, 0.0), minlength=k - 1)) / n
        back = np.cumsum(g_b[::-1])[::-1]
        g = np.concatenate([g_own, back[:1], back[1:] * np.exp(x[len(used) + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    w[used] = x[: len(used)]
    return w, np.cumsum(np.concatenate([x[len(used) : len(used) + 1], np.exp(x[len(used) + 1 :])]))


def _small(labels: DataFrame) -> DataFrame:
    """Broadcast labels only up to a counted size; beyond it the join shuffles."""
    return F.broadcast(labels) if labels.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else labels


def train(docs: DataFrame, ratings: DataFrame, k: int, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray] | None:
    """``ratings``: doc_id, grade (0 to k-1). None without usable ratings."""
    rated = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        import pyarrow as pa

        for part in slices(batches, "text", 4 << 20):
            texts = part.column("text").to_pylist()
            d, c, v = features(texts)
            key = d * BUCKETS + c
            key, at = np.unique(key, return_inverse=True)
            v = np.bincount(at, v, minlength=len(key))
            stop = np.searchsorted(key, np.arange(len(texts) + 1) * BUCKETS)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("grade").combine_chunks(),
                    pa.array([(key[a:b] % BUCKETS).astype("<i4").tobytes() for a, b in zip(stop, stop[1:])], pa.binary()),
                    pa.array([v[a:b].astype("<f4").tobytes() for a, b in zip(stop, stop[1:])], pa.binary()),
                ],
                ["grade", "cols", "vals"],
            )

    rows = common.texts(docs).join(F.broadcast(chosen), "doc_id").select("text", "grade").mapInArrow(run, "grade int, cols binary, vals binary").collect()
    if not rows:
        return None
    cols = [np.frombuffer(r["cols"], "<i4") for r in rows]
    vals = np.concatenate([np.frombuffer(r["vals"], "<f4") for r in rows]).astype(float)
    at = np.repeat(np.arange(len(rows)), [len(c) for c in cols])
    return fit(at, np.concatenate(cols), vals, np.array([r["grade"] for r in rows]), k)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, k: int) -> DataFrame:
    """doc_id, row_key, expected_grade and tails array<double> (P(grade >= 1), ...) of every row."""
    weights, cut = model if model else (np.zeros(BUCKETS), np.zeros(k - 1))
    weights = weights.astype(np.float32)

    def run(batches):
        import pyarrow as pa

        for part in slices(batches, "text", 2 << 20):
            texts = part.column("text").to_pylist()
            d, c, v = features(texts)
            f = np.bincount(d, v * weights[c], minlength=len(texts))
            tails = 1 / (1 + np.exp(-np.clip(f[:, None] - cut, -30, 30)))
            ends = pa.array(np.arange(len(texts) + 1) * (k - 1), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").combine_chunks(), part.column("row_key").combine_chunks(), pa.array(tails.sum(1)), pa.ListArray.from_arrays(ends, pa.array(tails.ravel()))],
                ["doc_id", "row_key", "expected_grade", "tails"],
            )

    source = common.texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), common.row_key().alias("row_key"), "text")
    return source.mapInArrow(run, "doc_id long, row_key long, expected_grade double, tails array<double>")


def select(docs: DataFrame, scores: DataFrame, keep: Column) -> DataFrame:
    """The rows of ``docs`` whose score satisfies ``keep``, each as often as it stands there, with all their columns."""
    good = scores.where(keep).select(F.col("row_key").alias("row")).distinct()
    whole = docs.select(common.row_key().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"))
    return whole.join(good, "row", "left_semi").select("whole.*")


#: Grades of the labels table: low quality, good but toxic, good and clean.
GRADES = 3


def ratings(labels: DataFrame) -> DataFrame:
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on the labelled rows whose crc32(doc_id) mod 5 is not 0; every document is scored."""
    docs, labels = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")
    scores = score(docs, train(docs, ratings(labels).where(~held_out()), GRADES), GRADES)
    return scores.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "expected_grade",
        F.col("tails")[0].alias("p_good"), F.col("tails")[1].alias("p_clean"),
        (F.col("tails")[0] >= 0.5).alias("kept"),
    )


def filtered(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a grade above 0 is at least one half."""
    labels = common.read(spark, sf_dir, "labels")
    model = train(docs, ratings(labels).where(~held_out()), GRADES)
    return keep_scored(docs, model)


def keep_scored(docs: DataFrame, model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` in place: scored and filtered in one pass, without a join."""
    weights, cut = model if model else (np.zeros(BUCKETS), np.zeros(GRADES - 1))
    weights = weights.astype(np.float32)
    line = float(np.log(least / (1 - least)) + cut[0])

    def run(batches):
        import pyarrow as pa

        for part in slices(batches, "text", 2 << 20):
            texts = [t or "" for t in part.column("text").to_pylist()]
            d, c, v = features(texts)
            f = np.bincount(d, v * weights[c], minlength=len(texts))
            yield from part.filter(pa.array(f >= line)).to_batches()

    return docs.mapInArrow(run, docs.schema)
