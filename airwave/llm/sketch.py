"""MinHash-style near-dedup with SetSketch registers.

A document's set of hashed word shingles is summarised by registers: for register i the minimum of
exponentially distributed hashes, kept as a truncated exponent to base ``BASE``. Registers merge by
maximum and agree the more often the more similar two sets are. Groups of ``ROWS`` registers form
bands; documents that agree on a band meet there. The joint likelihood of all registers and the set
sizes estimates the Jaccard index of a pair, hopeless pairs go, and the rest is verified on the full
sets. Only classes of equal sets take part, each by one of its rows.

What a group returns is a spanning forest, never its pairs. Every class first goes to its home, the
largest group it is in, and is held there against the members of one block (and a few leaders of a
larger group), but only where the two still lie in different components. The forests of all homes are
contracted. Of the groups that still hold several components, the large ones are dealt into other
blocks as long as that merges anything; then every pair of different components that meets in a group
is judged, once, in the first band that it shares. In a group beyond a block's size the largest
component is held against the rest, and the rest against itself; nothing is capped.

Defined cases: a null text or a text without words has the empty set and links with nothing; a text
of fewer words than a shingle is one shingle; repeated rows are equal sets and so linked; of rows that
share a doc_id each text is a document of its own, and component_id is the smallest doc_id of the
component; a null doc_id takes no part in links and stays; other columns, whatever their names, pass
through ``keep_first``, which keeps one row of a component (the smallest doc_id, of equal ones the
smallest row hash); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .components import components
from .hashing import SPACE, concatenate, mix, words
from .pieces import slices

#: bands and registers of a band; the chance that a pair at similarity 0.8 shares no band is below 1e-4
BANDS, ROWS = 25, 5
#: base and truncation of the registers, and how many standard errors below the threshold a pair's estimate may lie
BASE, LIMIT, SLACK = 1.05, 65_000, 4.0
#: members of a group that one task holds against each other, and leaders that all blocks of a larger group share
BLOCK, LEADERS = 512, 8
#: pairs that are estimated at once, bytes of text whose sets are made at once, shingles of sets that a task remembers
PAIRS, STEP, REMEMBERED = 2048, 4 << 20, 8 << 20

_MULT = (np.random.default_rng(20240229).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingles(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and where each text's begin (one more at the end)."""
    n = len(texts)
    buf, starts = concatenate(texts)
    h, doc, _, _ = words(buf, starts, ~SPACE)
    count = np.bincount(doc, minlength=n)
    x = h.copy()
    if len(h):
        for i in range(1, k):
            x[:-i] = mix(x[:-i] * np.uint64(0x9FB21C651E98DF25) + h[i:])
        place = np.arange(len(h)) - (np.cumsum(count) - count)[doc]
        full = place + k <= count[doc]
        few = np.flatnonzero((count > 0) & (count < k))
        whole = []
        at = np.cumsum(count) - count
        for d in few:
            v = np.full(1, int(count[d]) * 0xD6E8FEB86659FD93 & (1 << 64) - 1, np.uint64)
            for i in range(at[d], at[d] + count[d]):
                v = mix(v * np.uint64(0x9FB21C651E98DF25) + h[i : i + 1])
            whole.append(v[0])
        doc = np.concatenate([doc[full], few])
        x = np.concatenate([x[full], np.array(whole, np.uint64)])
    order = np.lexsort((x, doc))
    x, doc = x[order], doc[order]
    if len(x):
        fresh = np.r_[True, (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])]
        x, doc = x[fresh], doc[fresh]
    return x, np.searchsorted(doc, np.arange(n + 1))


def registers(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of each non-empty set; the rows of empty sets are 0."""
    sizes = np.diff(starts)
    some = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), BANDS * ROWS), np.uint16)
    if not len(some):
        return out
    low = np.empty((len(some), BANDS * ROWS), np.uint64)
    at = starts[:-1][some]
    for i, m in enumerate(_MULT):
        low[:, i] = np.minimum.reduceat(x * m, at)
    u = (low.astype(np.float64) + 0.5) * 2.0**-64
    # exponential with the set's size as rate; large sets have small minima and large exponents
    out[some] = np.clip(np.floor(1 - np.log(-np.log1p(-u)) / np.log(BASE)) + 1000, 1, LIMIT)
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard index from registers and exact set sizes: the share of equal
    registers and of those where either is larger, under the set sizes' exponential rates."""
    m = a.shape[-1]
    above, below = (a > b).sum(-1), (a < b).sum(-1)
    equal = m - above - below
    u, v = na / (na + nb), nb / (na + nb)
    grid = np.linspace(0, 1, 65)[1:-1]
    top = np.minimum(u / v, v / u)
    best, value = np.zeros(np.shape(u)), np.full(np.shape(u), -np.inf)
    log = np.log(BASE)
    # P(a > b) for the part of either set that the other lacks, on registers truncated to exponents
    p = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / log
    for g in grid:
        j = g * top
        pu, pv = np.clip(p(np.maximum(u - v * j, 1e-9)), 1e-9, 1), np.clip(p(np.maximum(v - u * j, 1e-9)), 1e-9, 1)
        score = above * np.log(pu) + below * np.log(pv) + equal * np.log(np.clip(1 - pu - pv, 1e-9, 1))
        better = score > value
        best, value = np.where(better, j, best), np.where(better, score, value)
    return best


def equal_floor(least: float, na, nb) -> np.ndarray:
    """Fewest equal registers that leave a similarity of ``least`` possible: cheap to hold against before the estimate."""
    m = BANDS * ROWS
    u, v = na / (na + nb), nb / (na + nb)
    p = 1 - sum(-np.log1p(-np.maximum(x, 1e-9) * (BASE - 1) / BASE) / np.log(BASE) for x in (u - v * least, v - u * least))
    p = np.clip(p, 0, 1)
    return m * p - SLACK * np.sqrt(m * p * (1 - p)) - 1


def floor_of(least: float) -> float:
    return least - SLACK * (least * (1 - least) / (BANDS * ROWS)) ** 0.5


def describe(docs: DataFrame, k: int) -> DataFrame:
    """row, doc_id, n (set size), set_key (128 bits of the sorted set), regs."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        for part in slices(batches, "text", 2 << 20):
            x, starts = shingles(part.column("text").to_pylist(), k)
            raw, regs = x.astype("<u8").tobytes(), registers(x, starts)
            keys = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(starts, starts[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column("row").combine_chunks(), part.column("doc_id").combine_chunks(), pa.array(np.diff(starts)), pa.array(keys, pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())],
                ["row", "doc_id", "n", "set_key", "regs"],
            )

    return _keyed(docs).mapInArrow(run, "row long, doc_id long, n long, set_key binary, regs binary")


def _keyed(docs: DataFrame) -> DataFrame:
    return common.texts(docs).select(common.row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def _bands(reps: DataFrame) -> DataFrame:
    """(band, nth, node): the hash and number of each band."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, BANDS, ROWS).astype(np.uint64)
            h = np.arange(1, BANDS + 1, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)
            for i in range(ROWS):
                h = mix(h * np.uint64(0x9FB21C651E98DF25) + regs[:, :, i])
            node = np.repeat(batch.column(0).to_numpy(), BANDS)
            nth = np.tile(np.arange(BANDS, dtype=np.int8), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(nth), pa.array(node)], ["band", "nth", "node"])

    return reps.select("node", "regs").mapInArrow(run, "band long, nth byte, node long")


def _whole_groups(batches, keys: int):
    """Tables of whole groups, of rows sorted by their first ``keys`` columns, with where groups begin and their
    sizes; the last group of a batch waits for what follows, so one group and one batch are in memory."""
    import pyarrow as pa

    def described(table):
        columns = [table.column(i).to_numpy() for i in range(keys)]
        starts = np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])
        return table, starts, np.diff(np.r_[starts, table.num_rows])

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        last = described(table)[1][-1]
        if last:
            yield described(table.slice(0, last))
        rest = table.slice(last)
    if rest is not None:
        yield described(rest)


class _Sets:
    """Full shingle sets of a table's rows, made when a pair asks for them; equal memory whatever the table."""

    def __init__(self, table, k: int):
        import pyarrow.compute as pc

        self.text, self.k = table.column("text"), k
        self.bytes = pc.binary_length(self.text).to_numpy().astype(np.int64)
        self.sets: dict[int, np.ndarray] = {}
        self.held = 0

    def have(self, rows: list[int]) -> None:
        new = [r for r in rows if r not in self.sets]
        if self.held > REMEMBERED:
            self.sets, self.held, new = {}, 0, rows
        if new:
            x, starts = shingles(self.text.take(new).to_pylist(), self.k)
            self.sets |= {r: x[a:b].copy() for r, a, b in zip(new, starts, starts[1:])}
            self.held += len(x)

    def common(self, i: int, j: int) -> int:
        a, b = self.sets[i], self.sets[j]
        both = np.concatenate([a, b])
        both.sort()
        return int((both[1:] == both[:-1]).sum())


def _forest(cells: DataFrame, members: DataFrame, k: int, num: int, den: int, each: bool) -> DataFrame:
    """(a, b): a spanning forest over the components that verified links join within each cell (band, lo, hi) of
    ``cells`` (band, nth, lo, hi, side, node, component). Rows of one side meet only where lo = hi. With ``each``
    a pair is judged in the first band that it shares alone."""
    least = num / den
    line = floor_of(least)

    def run(batches):
        import pyarrow as pa

        for table, starts, sizes in _whole_groups(batches, 3):
            if int(sizes.max()) < 2:
                continue
            regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(table.num_rows, -1)
            nth, lo, hi, side, comp, n = (table.column(c).to_numpy() for c in ("nth", "lo", "hi", "side", "component", "n"))
            label, sets, found = comp.copy(), _Sets(table, k), []
            begin, end = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)

            def judged(i, j):
                good = estimate(regs[i], regs[j], n[i].astype(float), n[j].astype(float))
                order = np.argsort(-good, kind="stable")
                order = order[good[order] >= line]
                pairs = list(zip(i[order].tolist(), j[order].tolist()))
                at = 0
                while at < len(pairs):
                    rows: dict[int, None] = {}
                    some, size = [], 0
                    while at < len(pairs) and (not some or size < STEP):
                        a, b = pairs[at]
                        at += 1
                        if label[a] != label[b]:
                            some.append((a, b))
                            for r in (a, b):
                                if r not in rows:
                                    rows[r] = None
                                    size += int(sets.bytes[r])
                    if some:
                        sets.have([*rows])
                    for a, b in some:
                        if label[a] != label[b]:
                            both = sets.common(a, b)
                            if den * both >= num * (n[a] + n[b] - both):
                                found.append((comp[a], comp[b]))
                                own = label[begin[a] : end[a]]
                                own[own == label[b]] = label[a]

            first, held, waiting = np.arange(table.num_rows), [], 0
            for shift in range(1, int(sizes.max())):
                first = first[first + shift < end[first]]
                i, j = first, first + shift
                ok = (label[i] != label[j]) & ((lo[i] == hi[i]) | (side[i] != side[j]))
                ok &= np.minimum(n[i], n[j]) >= np.floor(np.maximum(n[i], n[j]) * least * (1 - 1e-9))
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                same = regs[i] == regs[j]
                ok = same.sum(1) >= equal_floor(least, n[i].astype(float), n[j].astype(float))
                if each:
                    shared = same[ok].reshape(-1, BANDS, ROWS).all(2)
                    ok[ok] = shared.argmax(1) == nth[i[ok]]
                held.append((i[ok], j[ok]))
                waiting += int(ok.sum())
                if shift < 4 or waiting >= PAIRS:
                    judged(*map(np.concatenate, zip(*held)))
                    held, waiting = [], 0
            if held:
                judged(*map(np.concatenate, zip(*held)))
            if found:
                a, b = map(np.array, zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    rows = cells.join(members, cells["node"] == members["row"]).select("band", "lo", "hi", "nth", "side", "node", "component", "n", "regs", "text")
    dealt = rows.repartition(common.partitions(cells.sparkSession), "band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "node")
    return common.cut(dealt.mapInArrow(run, "a long, b long"), "forest")


def _homes(met: DataFrame, turn: int) -> DataFrame:
    """Cells of ``met`` (band, nth, node, c, component): each node in a block of its largest group, with the
    group's leaders in every block."""
    home = met.groupBy("node").agg(F.max(F.struct("c", "band", "nth", "component")).alias("h")).select("node", "h.*")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    mine = home.select("band", "nth", F.pmod(F.xxhash64("node", F.lit(turn)), blocks.cast("long")).cast("int").alias("lo"), "node", "component")
    rank = F.xxhash64("node", F.lit(turn + 1000))
    leads = home.where(F.col("c") > BLOCK).groupBy("band", "c", F.pmod(rank, F.lit(LEADERS)).alias("s")).agg(F.min_by(F.struct("nth", "node", "component"), rank).alias("l"))
    leads = leads.select("band", "l.nth", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("lo"), "l.node", "l.component")
    both = mine.unionByName(leads)
    return both.select("band", "nth", "lo", F.col("lo").alias("hi"), F.lit(0).alias("side"), "node", "component")


def _every(mixed: DataFrame) -> DataFrame:
    """Cells in which every pair of different components of a group meets: one for a group within a block; beyond
    it blocks of the largest component against blocks of the rest, and blocks of the rest against each other."""
    small = mixed.where(F.col("c") <= BLOCK).select("band", "nth", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("side"), "node", "component")
    large = mixed.where(F.col("c") > BLOCK)
    most = large.groupBy("band", "component").agg(F.count("*").alias("m")).groupBy("band").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("all"))
    rows = large.join(most, "band").withColumn("rest", F.col("component") != F.col("top.component"))
    lb, rb = F.ceil(F.col("top.m") / BLOCK).cast("int"), F.ceil((F.col("all") - F.col("top.m")) / BLOCK).cast("int")
    rows = rows.withColumn("lb", lb).withColumn("rb", rb)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("rb")).otherwise(F.col("lb")).cast("long")).cast("int"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    cell = lambda lo, hi, side: F.struct(lo.alias("lo"), hi.alias("hi"), side.alias("side"))
    against_top = F.transform(upto("lb"), lambda i: cell(i, -1 - F.col("own"), F.lit(2)))
    each_other = F.transform(upto("rb"), lambda j: cell(F.least("own", j), F.greatest("own", j), F.col("own") + 3))
    cells = F.when(F.col("rest"), F.concat(against_top, each_other)).otherwise(F.transform(upto("rb"), lambda j: cell(F.col("own"), -1 - j, F.lit(1))))
    wide = rows.select("band", "nth", F.explode(cells).alias("x"), "node", "component").select("band", "nth", "x.lo", "x.hi", "x.side", "node", "component")
    return small.unionByName(wide)


def _resolved(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """row, doc_id, n, component (null where a row takes no part in links), component_id."""
    rows = common.cut(describe(docs, k), "sets")
    some = rows.where("n > 0 and doc_id is not null")
    reps = some.groupBy("set_key").agg(F.min("doc_id").alias("least_id"), F.min("row").alias("node"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    reps = common.cut(reps, "reps")
    bands = common.cut(_bands(reps), "bands")
    groups = bands.groupBy("band").agg(F.count("*").alias("c")).where("c > 1")
    met = common.cut(bands.join(common.cut(groups, "groups"), "band"), "met")
    needed = reps.select("node", "n", "regs").join(met.select("node").distinct(), "node", "left_semi")
    texts = _keyed(docs).select("row", "text").dropDuplicates(["row"])
    members = common.bucketed(texts.join(needed.hint("merge"), F.col("row") == F.col("node")).select("row", "n", "regs", "text"), "row", dealt=True)
    comp, turn, moved = None, 0, 0
    cells = _homes(met.withColumn("component", F.col("node")), 0)
    while True:
        edges = _forest(cells, members, k, num, den, turn < 0)
        merged = edges.count()
        if merged:
            step = components(edges)
            known = step.select(F.col("node").alias("component"), F.col("component").alias("_to"))
            if comp is None:
                comp = step
            else:  # contract what was known, and add what is new
                old = comp.join(known, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
                comp = common.cut(old.unionByName(step.join(comp.select("node"), "node", "left_anti")), "contracted")
        if turn < 0:
            break
        placed = met if comp is None else met.join(comp, "node", "left")
        placed = placed.select("band", "nth", "node", "c", F.coalesce(F.col("component"), F.col("node")).alias("component") if comp is not None else F.col("node").alias("component"))
        placed = common.cut(placed, "placed")
        several = placed.groupBy("band").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo <> _hi").select("band")
        mixed = common.cut(placed.join(common.cut(several, "several"), "band"), "mixed")
        crowd = mixed.where(F.col("c") > BLOCK)
        if (turn == 0 or merged * 50 >= moved) and crowd.limit(1).count():
            turn, moved = turn + 1, crowd.select("node").distinct().count()
            cells = _homes(crowd, turn)
        else:
            turn, cells = -1, _every(mixed)
    reps = reps.select("set_key", "node", "least_id")
    tied = reps.join(comp, "node", "left").select("set_key", "least_id", F.coalesce("component", "node").alias("component")) if comp is not None else reps.select("set_key", "least_id", F.col("node").alias("component"))
    tied = common.cut(tied, "tied")
    ids = tied.groupBy("component").agg(F.min("least_id").alias("component_id"))
    tied = tied.join(ids, "component").select(F.col("set_key").alias("_key"), "component", "component_id")
    linked = rows.withColumn("_link", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("set_key")))
    out = linked.join(tied, F.col("_link") == F.col("_key"), "left")
    return out.select("row", "doc_id", "n", "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: links are pairs with den * intersection >= num * union."""
    out = _resolved(docs, k, num, den)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component, with all its columns; rows that take no part in links stay."""
    found = common.cut(_resolved(docs, k, num, den).where("component is not null").select("row", "doc_id", "component"), "resolved")
    stay = found.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("s")).select(F.col("s.row").alias("row"))
    gone = found.select("row").distinct().join(stay, "row", "left_anti")
    whole = docs.select(common.row_key().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"))
    left = whole.join(gone, "row", "left_anti").withColumn("nth", F.row_number().over(W.partitionBy("row").orderBy("row")))
    apart = F.col("whole.doc_id").isNull() | ~F.coalesce(F.col("whole.text"), F.lit("")).rlike(r"[^ \x09-\x0D]")
    return left.where((F.col("nth") == 1) | apart).select("whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents"), 3, 85, 100)
