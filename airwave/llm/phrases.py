"""Phrase collocations by multikey three-way quicksort of suffix pointers.

A suffix is a place in a piece of text and the words that follow it there, as many as the longest phrase has.
Suffixes are routed to owners by their leading words, all over the corpus, and an owner sorts its pointers
word by word: a partition is split by a pivot into words before it, equal to it and after it, and only the
equal part goes on to the next word. The size of an equal part at depth d is the count of its first d words.
Partitions below ``least`` are abandoned at once: nothing in them can be a phrase.

1. Words are counted by language; those below ``least`` end every suffix that meets them.
2. Suffixes of two words are routed by both; owners keep the pairs that are frequent.
3. Suffixes whose neighbouring pairs are all frequent are routed by three words and sorted to full depth.

Tasks send distinct suffixes with their numbers, not places, so what a third of all documents repeats is one
entry of each task, and a common leading word is spread over owners by the words that follow it. A word is a
64-bit key of its language and bytes; the table of all words tells if two share one, and then another seed is
taken. Frequent words and pairs filter early if they are at most ``WHOLE``; beyond that suffixes go unfiltered,
and owners find the same.

Defined cases: a null text is empty, a null language is ``und``; pieces end at any of ``.,;:!?``, line feeds and
the controls up to carriage return; a word is whatever stands between blanks or tabs; repeated rows count each;
languages with equal phrases have counts of their own; other columns are left out; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .hashing import LOWER, Probe, concatenate, mix, stretch_hash
from .pieces import gather, slices

#: frequent words or pairs that are broadcast, bytes of text read at a time, suffixes that a task holds before it sends them,
#: bytes of blobs that it sends at a time
WHOLE, STEP, HELD, SENT = 1 << 22, 2 << 20, 2 << 20, 4 << 20
#: pointers of a partition that a plain sort finishes, and candidates that one task ranks
SMALL, RANKED = 1 << 12, 1 << 17

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
BLANK = np.zeros(256, bool)
BLANK[[9, 32]] = True
_NEXT = np.uint64(0x9FB21C651E98DF25)
#: stands after the last word of a suffix; no word has this key
END = np.uint64(2**64 - 1)


def read_words(part, seed: int):
    """Key of every word of the texts, whether the next word is in the same piece, text, folded bytes, first and last+1 byte."""
    buf, starts = concatenate(part.column("text").to_pylist())
    inside = ~(BREAK | BLANK)[buf]
    none = np.zeros(1, np.int8)
    edge = np.diff(np.concatenate([none, inside.view(np.int8), none]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    low = LOWER[buf]
    doc = np.searchsorted(starts, first, "right") - 1
    of_lang = part.column("lkey").to_numpy().view(np.uint64)
    key = mix(stretch_hash(low, first, last, seed) ^ of_lang[doc])
    key[key == END] = END - np.uint64(1)
    piece = np.cumsum(BREAK[buf], dtype=np.int32)[first]
    same = np.r_[piece[1:] == piece[:-1], False] if len(piece) else np.zeros(0, bool)
    return key, same, doc, low, first, last


def vocabulary(rows: DataFrame, seed: int) -> DataFrame:
    """(key, lang, word, n), written and dealt by key."""

    def run(batches):
        import pyarrow as pa

        for part in slices(batches, "text", STEP):
            key, _, doc, low, first, last = read_words(part, seed)
            key, one, n = np.unique(key, return_index=True, return_counts=True)
            data, ends = gather(low, first, last - first, one)
            word = pa.StringArray.from_buffers(len(one), pa.py_buffer(np.r_[0, ends].astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))
            lang = part.column("lang").combine_chunks().take(pa.array(doc[one]))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), lang, word, pa.array(n)], ["key", "lang", "word", "n"])

    counted = rows.mapInArrow(run, "key long, lang string, word string, n long").repartition(common.partitions(rows.sparkSession), "key")
    return common.cut(counted.groupBy("key", "lang", "word").agg(F.sum("n").alias("n")), "vocabulary")


def _sorted_keys(rows: DataFrame) -> np.ndarray | None:
    """The keys of ``rows`` in order, the column key or for pairs what names ``words``, if they are at most ``WHOLE``. They are
    named and packed in one pass: one over another would have two Python workers a task, and the executor keeps both."""
    if rows.count() > WHOLE:
        return None

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys = batch.column(0)
            if pa.types.is_list(keys.type):
                k = keys.flatten().to_numpy().view(np.uint64).reshape(-1, 2)
                keys = pair_key(k[:, 0], k[:, 1])
            else:
                keys = keys.to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary())], ["keys"])

    packed = rows.select("key" if "key" in rows.columns else "words").mapInArrow(run, "keys binary")
    return np.sort(np.frombuffer(b"".join(bytes(r["keys"]) for r in packed.collect()), np.uint64))


class Coder:
    """Words as numbers: places in the sorted frequent keys, or where these are too many the keys themselves."""

    def __init__(self, keys: np.ndarray | None):
        self.probe = None if keys is None else Probe(keys)
        self.kind = np.dtype("<u8" if keys is None else "<u4")
        self.end = END if keys is None else np.uint64(2**32 - 1)

    def encode(self, key: np.ndarray) -> np.ndarray:
        if self.probe is None:
            return key
        at, which = self.probe(key)
        out = np.full(len(key), self.end, np.uint64)
        out[at] = which
        return out

    def decode(self, number: np.ndarray) -> np.ndarray:
        return number if self.probe is None else self.probe.keys[number.astype(np.int64)]


def distinct(columns: list[np.ndarray], small: bool) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order and how often each stands there; ``small``: numbers fit 32 bits, and so two fit one key.
    The list is used up, so that no column is held longer than it is read."""
    if small:
        width, packed = len(columns), []
        while columns:
            key = columns.pop(0).astype(np.uint64) << np.uint64(32)
            if columns:
                key |= columns.pop(0)
            packed.append(key)
        columns = packed
    if len(columns) == 1:
        key, n = np.unique(columns[0], return_counts=True)
        columns = [key]
    else:
        order = np.lexsort(columns[::-1])
        new = np.zeros(len(order), bool)
        new[:1] = True
        for i, c in enumerate(columns):
            columns[i] = c = c[order]
            new[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(new)
        n = np.diff(np.r_[at, len(order)])
        del c, order, new
        for i in range(len(columns)):
            columns[i] = columns[i][at]
    if small:
        columns = [x for c in columns for x in ((c >> np.uint64(32)).astype(np.uint32), c.astype(np.uint32))][:width]
    return columns, n


def route(columns: list[np.ndarray], n: np.ndarray, lead: int, buckets: int, kind: np.dtype) -> Iterator:
    """(bucket, size, blob): the suffixes of each bucket, which their ``lead`` first words decide; one column after the other.
    The list is used up."""
    h = np.full(len(n), 7, np.uint64)
    for c in columns[:lead]:
        h = mix(h * _NEXT + c)
    bucket = (h % np.uint64(buckets)).astype(np.int32)
    del h
    order = np.argsort(bucket, kind="stable")
    bucket, n = bucket[order], n[order].astype("<u4")
    for i in range(len(columns)):
        columns[i] = columns[i][order].astype(kind, copy=False)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    del order
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(bucket)]):
        yield int(bucket[a]), b - a, b"".join([*(c[a:b].tobytes() for c in columns), n[a:b].tobytes()])
    columns.clear()


def together(routed: Iterator) -> Iterator[list]:
    """Blobs of some ``SENT`` bytes at a time, or one longer one: each lot is one Arrow batch, which the JVM holds whole."""
    some, size = [], 0
    for one in routed:
        if some and size + len(one[2]) > SENT:
            yield some
            some, size = [], 0
        some.append(one)
        size += len(one[2])
    if some:
        yield some


def quicksort(columns: list[np.ndarray], weight: np.ndarray, least: int, end, shortest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, pointers, counts): for phrases of ``shortest`` words or more that weigh ``least`` or more, a pointer to one
    suffix that begins with it, and its count."""
    pointers, depths = np.arange(len(weight)), len(columns)
    todo = [(0, len(weight), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        own = pointers[lo:hi]
        if weight[own].sum() < least:
            continue  # abandoned
        if hi - lo <= SMALL:
            yield from _finish(columns, weight, own, depth, least, end, shortest)
            continue
        word = columns[depth][own]
        pivot = np.sort(word[[0, len(word) // 2, len(word) - 1]])[1]
        before, equal, after = own[word < pivot], own[word == pivot], own[word > pivot]
        pointers[lo:hi] = np.concatenate([before, equal, after])
        a, b = lo + len(before), lo + len(before) + len(equal)
        todo += [(lo, a, depth), (b, hi, depth)]
        count = weight[equal].sum()
        if pivot != end and count >= least:
            if depth + 1 >= shortest:
                yield depth + 1, equal[:1], np.array([count])
            if depth + 1 < depths:
                todo.append((a, b, depth + 1))


def _finish(columns, weight, own, depth, least, end, shortest):
    """A small partition, equal in its first ``depth`` words: a plain sort by the others, and the sizes of its equal parts."""
    words = [c[own] for c in columns[depth:]]
    order = np.lexsort(words[::-1])
    own, w = own[order], weight[own][order]
    new = np.zeros(len(own), bool)
    new[:1] = True
    for d, word in enumerate(words, depth + 1):
        word = word[order]
        new[1:] |= word[1:] != word[:-1]
        at = np.flatnonzero(new)
        counts = np.add.reduceat(w, at)
        good = (counts >= least) & (word[at] != end)
        if not good.any():
            return
        if d >= shortest:
            yield d, own[at[good]], counts[good]


def counts(rows: DataFrame, seed: int, least: int, words_known, pairs_known, longest: int) -> DataFrame:
    """(words array<long>, f): frequent phrases of two words (``pairs_known`` None), or of 3 to ``longest`` words."""
    spark, first_round = rows.sparkSession, longest == 2
    n = common.partitions(spark)
    buckets, lead = 4 * n, 2 if first_round else 3

    def suffixes(batches):
        import pyarrow as pa

        coder = Coder(words_known.value)
        pairs = Probe(pairs_known.value) if pairs_known is not None and pairs_known.value is not None else None
        small = coder.kind.itemsize == 4
        held: list[list[np.ndarray]] = []

        def sent():
            columns = []
            for i in range(longest):
                columns.append(np.concatenate([h[i] for h in held]))
                for h in held:
                    h[i] = None
            held.clear()
            columns, n = distinct(columns, small)
            for some in together(route(columns, n, lead, buckets, coder.kind)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), (pa.int32(), pa.int32(), pa.binary()))], ["bucket", "size", "blob"])

        def read(part):
            key, same = read_words(part, seed)[:2]
            if not len(key):
                return None
            word = coder.encode(key)
            goes = same & (word != coder.end) & np.r_[word[1:] != coder.end, False]  # the next word continues this one
            if pairs is not None:
                at = np.flatnonzero(goes)
                goes[:] = False
                goes[at[pairs(pair_key(key[at], key[at + 1]))[0]]] = True
            wide = np.concatenate([word, np.full(longest, coder.end)]).astype(coder.kind)
            at = np.flatnonzero(goes if first_round else goes & np.r_[goes[1:], False])
            columns, on = [wide[at]], np.ones(len(at), bool)
            more = np.concatenate([goes, np.zeros(longest, bool)])
            for d in range(1, longest):
                on = on & more[at + d - 1]
                columns.append(np.where(on, wide[at + d], coder.end.astype(coder.kind)))
            return columns

        for part in slices(batches, "text", STEP):
            if columns := read(part):
                held.append(columns)
            if sum(len(h[0]) for h in held) >= HELD:
                yield from sent()
        if held:
            yield from sent()

    def owners(batches):
        import pyarrow as pa

        coder = Coder(words_known.value)
        width = coder.kind.itemsize

        def sorted_(blobs):
            parts = [[np.frombuffer(b, coder.kind, m, i * m * width) for i in range(longest)] + [np.frombuffer(b, "<u4", m, longest * m * width)] for m, b in blobs]
            columns = [np.concatenate(c) for c in zip(*parts)]
            found = quicksort(columns[:-1], columns[-1].astype(np.int64), least, coder.end, lead)
            by_depth: dict[int, list] = {}
            for depth, at, f in found:
                by_depth.setdefault(depth, []).append((at, f))
            for depth, those in by_depth.items():
                at, f = (np.concatenate(x) for x in zip(*those))
                keys = np.stack([coder.decode(c[at]) for c in columns[:depth]], 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * depth), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([lists, pa.array(f)], ["words", "f"])

        own, blobs = None, []
        for batch in batches:
            for bucket, size, blob in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2)):
                if bucket != own and blobs:
                    yield from sorted_(blobs)
                    blobs = []
                own = bucket
                blobs.append((size, blob.as_buffer()))  # read where the batch has it
        if blobs:
            yield from sorted_(blobs)

    sent = rows.mapInArrow(suffixes, "bucket int, size int, blob binary")
    return sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(owners, "words array<long>, f long")


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names a pair where pairs only filter: two pairs on one name cost time, nothing else."""
    return mix(a * _NEXT + b)


def frequent(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """(words array<long>, f) of every phrase of 1 to ``longest`` words found ``least`` times, and the vocabulary
    (key, lang, word, n)."""
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), lang.alias("lang"), F.xxhash64(lang).alias("lkey"))
    seed = 0
    while (words := vocabulary(rows, seed)).groupBy("key").count().where("count > 1").limit(1).count():
        common.discard(words)
        seed += 1
    often = words.where(F.col("n") >= least)
    share = spark.sparkContext.broadcast
    known = share(_sorted_keys(often))
    rows = rows.select("text", "lkey")
    pairs = common.cut(counts(rows, seed, least, known, None, 2), "pairs")
    out = often.select(F.array("key").alias("words"), F.col("n").alias("f")).unionByName(pairs)
    if longest > 2:
        pair_keys = share(_sorted_keys(pairs))
        out = out.unionByName(common.cut(counts(rows, seed, least, known, pair_keys, longest), "longer"))
    return out, words


def scored(phrases: DataFrame) -> DataFrame:
    """(words, a, l, r, score) of every phrase of two words or more, by its lowest-scoring cut (ties: the first)."""
    count = lambda name, key: phrases.select(F.col("words").alias(key), F.col("f").alias(name))
    some = phrases.where(F.size("words") > 1).select("words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    some = some.withColumns({"_left": F.slice("words", F.lit(1), F.col("k")), "_right": F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))})
    both = some.join(count("l", "_left"), "_left").join(count("r", "_right"), "_right")
    score = F.expr("(2000000 * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m")
    return both.groupBy("words", "a").agg(lowest).select("words", "a", "m.l", "m.r", "m.score")


def inside_longer(phrases: DataFrame) -> DataFrame:
    """(words, longer): the count of the most frequent phrase that holds the words in a row and is longer."""
    parts = lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: F.slice("words", i, m))
    long_ = phrases.where(F.size("words") > 2)
    every = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), parts))
    return long_.select(F.explode(every).alias("words"), "f").groupBy("words").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, share: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of ``docs`` (text, lang); a phrase goes
    where a longer one that holds it has ``share`` percent of its count."""
    found, words = frequent(docs, least, longest)
    left = scored(found).join(inside_longer(found), "words", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    left = common.cut(left.drop("longer"), "scored")
    spelt = left.select("words", F.posexplode("words").alias("at", "key")).join(words.where(F.col("n") >= least).select("key", "lang", "word"), "key")
    text = F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]))
    spelt = spelt.groupBy("words").agg(F.first("lang").alias("lang"), text.alias("phrase"))
    rows = common.cut(left.join(spelt, "words").drop("words"), "spelt")
    order: list[Column] = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    groups = -(-rows.count() // RANKED)
    if groups > 1:  # the first of each group hold the first of all
        salt = F.pmod(F.xxhash64("phrase"), F.lit(groups))
        rows = rows.withColumn("_nth", F.row_number().over(W.partitionBy("lang", salt).orderBy(*order))).where(F.col("_nth") <= top).drop("_nth")
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.read(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece FROM documents
),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM p),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, w[i:i + m - 1] AS g FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, 5) t(m))),
f AS MATERIALIZED (SELECT lang, g, len(g) AS m, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, k, l.f AS l, r.f AS r, CAST((CAST(2000000 AS HUGEINT) * c.f) // (l.f + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) c JOIN f l ON l.lang = c.lang AND l.g = c.g[1:k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1:]
),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
longer AS (
  SELECT lang, g[i:i + s - 1] AS g, max(f) AS top
  FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM f WHERE m > 2)) GROUP BY ALL
),
kept AS (SELECT o.lang, array_to_string(o.g, ' ') AS phrase, a, l, r, score FROM lowest o LEFT JOIN longer USING (lang, g) WHERE top IS NULL OR 100 * top < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
