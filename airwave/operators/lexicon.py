"""Weighted terms in token lists: matching, and the polarity that matched terms add up to.

Matching and weighing look at a token's neighbours, which its row holds in order; so both work on token arrays where
they are, in Arrow batches, and only matches leave a row. Tokens are looked at once per distinct token of a batch;
what is neither a term, the beginning of one, a modifier nor a negator costs no step of its own. The functions are said to
be not deterministic, since the optimizer otherwise runs them a second time to leave out rows before they unfold."""

from __future__ import annotations

from copy import copy
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import keep

#: fixed values: words that turn the next tokens around, and factors of words that strengthen or weaken
NEGATORS = ["no", "non", "nicht", "not"]
MODIFIERS = {"muy": 1.5, "sehr": 1.5, "so": 1.3, "very": 1.5, "wenig": 0.6, "poco": 0.6, "peu": 0.6, "slightly": 0.6}
#: fixed values: how far negation reaches, what a negated value keeps, the neutral band, and the softmax scales
SCOPE, FLIPPED, BAND, SCALE, CALM = 3, -0.8, 0.35, 1.6, 1.4


#: terms, and characters of terms, up to which an automaton goes to every worker
MOST_TERMS, MOST_CHARS = 1 << 18, 1 << 23
#: stands for a null in a token list; no term holds it
NO_TOKEN = "\x00"
_MATCH = "array<struct<pos:int,words:int,term:string,via:string>>"


class _Lists:
    """The values of a list column as codes of its distinct values, and where each row's begin."""

    def __init__(self, column: pa.Array):
        n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        coded = pc.fill_null(column.flatten(), NO_TOKEN).dictionary_encode()
        self.starts = np.concatenate([[0], np.cumsum(n)])
        self.distinct, self.codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    @cached_property
    def words(self) -> list[str]:
        return self.distinct.to_pylist()

    @property
    def rows(self) -> np.ndarray:
        """The row of each value."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def only(self, which: np.ndarray) -> _Lists:
        """The values whose code is one of ``which``, in the same rows."""
        out, there = copy(self), which[self.codes]
        out.starts, out.codes = np.concatenate([[0], np.cumsum(there)])[self.starts], self.codes[there]
        return out

    def among(self, values: list[str]) -> np.ndarray:
        """Which distinct words are among ``values``."""
        return pc.is_in(self.distinct, value_set=pa.array(values, pa.string())).to_numpy(zero_copy_only=False)

    def table(self, value) -> np.ndarray:
        """``value`` of each distinct word."""
        return np.array([value(w) for w in self.words]) if len(self.distinct) else np.zeros(0, bool)

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, code and count of the distinct words of each row."""
        cells = np.sort(self.rows * max(len(self.distinct), 1) + self.codes)
        first = np.flatnonzero(np.diff(cells, prepend=-1))
        return *np.divmod(cells[first], max(len(self.distinct), 1)), np.diff(first, append=len(cells))

    def lists(self, row, values: pa.Array) -> pa.ListArray:
        """``values``, in order of their ``row``, as a list a row."""
        ends = np.searchsorted(np.asarray(row, np.int64), np.arange(len(self.starts)))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


#: tokens of rows that are looked at together, so that what a worker holds does not grow with Arrow's batches
TOGETHER = 1 << 16


def stretches(column: pa.Array, most: int):
    """First and last row of stretches of lists that hold some ``most`` values together, or are one row."""
    upto = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(column):
        hi = max(int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")), lo + 1)
        yield lo, hi
        lo = hi


class Matcher:
    """An Aho-Corasick automaton over the terms; built where it is used."""

    def __init__(self, terms: list[str], max_phrase: int, min_sub: int, sep: str):
        self.terms, self.max_phrase, self.min_sub, self.sep = terms, max_phrase, min_sub, sep
        self.longest = max(map(len, terms), default=0)
        self.known = self.tree = None

    def __getstate__(self):
        return {**self.__dict__, "known": None, "tree": None}

    def _built(self):
        if self.known is None:
            import ahocorasick

            self.known, self.tree = frozenset(self.terms), ahocorasick.Automaton()
            for t in self.terms:
                self.tree.add_word(t, t)
            self.tree.make_automaton()

    def inside(self, word: str) -> str | None:
        """The longest term of ``min_sub`` characters or more inside a longer word; of equal ones the smaller."""
        if len(word) <= self.min_sub or not self.terms:
            return None
        fits = [t for _, t in self.tree.iter(word) if self.min_sub <= len(t) < len(word)]
        return min(fits, key=lambda t: (-len(t), t), default=None)

    def __call__(self, column: pa.Array) -> pa.Array:
        parts = [self.found(_Lists(column.slice(lo, hi - lo))) for lo, hi in stretches(column, TOGETHER)]
        return pa.concat_arrays(parts) if parts else self.found(_Lists(column))

    def found(self, lists: _Lists) -> pa.Array:
        """The matches of each row."""
        self._built()
        codes, starts = lists.codes, lists.starts
        exact = lists.among(self.terms)
        leads = lists.table(lambda w: w != "" and self.tree.match(w + self.sep)) if self.max_phrase > 1 else np.zeros(len(exact), bool)
        # no word has a part to look for where no term is long enough to be one
        inner = pa.array([None if e else self.inside(w) for w, e in zip(lists.words, exact)], pa.string()) if self.longest >= self.min_sub else pa.nulls(len(exact), pa.string())
        alone = pc.if_else(pa.array(exact), lists.distinct, inner)
        begin, size, term = self._phrases(lists, leads)
        # a token alone keeps no other from its match, so only phrases cover tokens
        free = np.ones(len(codes), bool)
        free[_spread(begin, size)] = False
        some = alone.is_valid().to_numpy(zero_copy_only=False)
        single = np.flatnonzero(some[codes] & free) if len(codes) else np.zeros(0, np.int64)
        at = np.concatenate([begin, single])
        order = np.argsort(at, kind="stable")
        texts = pa.chunked_array([pa.array(term, pa.string()), alone.take(pa.array(codes[single]))]).combine_chunks().take(pa.array(order))
        kinds = pa.array(["phrase", "exact", "compound"]).take(pa.array(np.concatenate([np.zeros(len(begin), np.int64), np.where(exact[codes[single]], 1, 2) if len(single) else single])[order]))
        at, size = at[order], np.concatenate([size, np.ones(len(single), np.int64)])[order]
        row = np.searchsorted(starts, at, "right") - 1
        values = pa.StructArray.from_arrays([pa.array((at - starts[row]).astype(np.int32)), pa.array(size.astype(np.int32)), texts, kinds], ["pos", "words", "term", "via"])
        return lists.lists(row, values)

    def counts(self, column: pa.Array) -> pa.Array:
        """How often each matched term stands in each row, terms in order."""
        return self.tallied(self(column))

    def tallied(self, found: pa.Array) -> pa.Array:
        """As ``counts`` of the matches ``found``."""
        coded = found.flatten().field("term").dictionary_encode()
        names = np.array(coded.dictionary.to_pylist(), object)
        rank = np.argsort(np.argsort(names)) if len(names) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(found)), np.asarray(found.value_lengths().fill_null(0)))
        cells, n = np.unique(row * max(len(names), 1) + rank[coded.indices.to_numpy()], return_counts=True)
        row, rank = np.divmod(cells, max(len(names), 1))
        values = pa.StructArray.from_arrays([pa.array(np.sort(names)[rank], pa.string()), pa.array(n.astype(np.int64))], ["term", "n"])
        ends = np.searchsorted(row, np.arange(len(found) + 1))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    def _phrases(self, lists: _Lists, leads: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """First token, tokens and term of every phrase, from the left and without overlap."""
        found, free, codes, starts = [], 0, lists.codes, lists.starts  # free: the next token that no phrase covers
        at = np.flatnonzero(leads[codes]) if len(codes) else np.zeros(0, np.int64)
        ends = starts[np.searchsorted(starts, at, "right")] if len(at) else at
        for i, end in zip(at.tolist(), ends.tolist()):
            if i < free:
                continue
            for n in range(min(self.max_phrase, end - i), 1, -1):
                term = self.sep.join(lists.words[c] for c in codes[i : i + n])
                if term in self.known:
                    found.append((i, n, term))
                    free = i + n
                    break
        begin, size, terms = zip(*found) if found else ((),) * 3
        return np.array(begin, np.int64), np.array(size, np.int64), list(terms)


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of every stretch."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


def _weigh(lists: _Lists, matches: pa.Array) -> pa.Array:
    """Of each match the product of the factors that wait for it and of one right after it, and whether it is negated."""
    m, codes, starts = matches.flatten(), lists.codes, lists.starts
    place = pc.fill_null(pc.index_in(lists.distinct, value_set=pa.array([*MODIFIERS])), -1).to_numpy(zero_copy_only=False)
    factor, no = np.array([*MODIFIERS.values(), 1.0])[place], lists.among(NEGATORS)
    first, words = (x.to_numpy() for x in m.flatten()[:2])
    per_row = np.asarray(matches.value_lengths().fill_null(0))
    row = np.repeat(np.arange(len(per_row)), per_row)
    begin = first + starts[row]
    after = begin + words
    open_ = np.ones(len(codes), bool)
    open_[_spread(begin, words.astype(np.int64))] = False
    turns = lambda which: np.flatnonzero(which[codes] & open_) if len(codes) else np.zeros(0, np.int64)
    product = np.ones(len(begin))
    # an open modifier waits for the next match of its row
    t = turns(factor != 1.0)
    j = np.searchsorted(begin, t)
    waits = (j < len(begin)) & (t >= starts[np.r_[row, len(starts) - 1][j]])
    np.multiply.at(product, j[waits], factor[codes[t[waits]]])
    near = np.flatnonzero(after < starts[row + 1])
    product[near] *= factor[codes[after[near]]]
    # the last open negator before the match, if it stands in its row
    t = np.r_[np.int64(-SCOPE - 1), turns(no)]
    said = t[np.searchsorted(t, begin) - 1]
    negated = (said >= starts[row]) & (begin <= said + SCOPE)
    values = pa.StructArray.from_arrays([pa.array(product), pa.array(negated)], ["multiplier", "negated"])
    return lists.lists(row, values)


def _evidence(found: pa.Array, weighed: pa.Array) -> pa.Array:
    """The matches ``found`` of each row with what they weigh, equal ones counted."""
    coded, w = found.flatten().field("term").dictionary_encode(), weighed.flatten()
    factor, kind = np.unique(w.field("multiplier").to_numpy(), return_inverse=True)
    row = np.repeat(np.arange(len(found)), np.asarray(found.value_lengths().fill_null(0)))
    terms, factors = max(len(coded.dictionary), 1), max(len(factor), 1)
    cells, n = np.unique(((row * terms + coded.indices.to_numpy()) * factors + kind) * 2 + w.field("negated").to_numpy(zero_copy_only=False), return_counts=True)
    rest, negated = np.divmod(cells, 2)
    rest, kind = np.divmod(rest, factors)
    row, term = np.divmod(rest, terms)
    values = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(term)), pa.array(negated.astype(bool)), pa.array(factor[kind]), pa.array(n.astype(np.int64))], ["term", "negated", "multiplier", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(found) + 1)), pa.int32()), values)


#: what ``_evidence`` and ``Matcher.tallied`` give
EVIDENCE, COUNTS = "array<struct<term:string,negated:boolean,multiplier:double,n:bigint>>", "array<struct<term:string,n:bigint>>"


def _matcher(terms: DataFrame, max_phrase: int, min_sub: int, sep: str) -> tuple[Matcher | None, DataFrame, int]:
    """The automaton over the distinct ``terms``, none if they are too many for it; those terms, and their most words."""
    distinct = terms.where("term <> ''").select("term").distinct()
    size = distinct.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("chars"), F.max(F.size(F.split("term", sep)) if sep else F.lit(max_phrase)).alias("wide")).first()
    wide = min(max_phrase, size["wide"] or 1)
    if size["n"] > MOST_TERMS or size["chars"] > MOST_CHARS:
        return None, distinct, wide
    return Matcher(sorted(r["term"] for r in distinct.collect()), wide, min_sub, sep), distinct, wide


def with_matches(rows: DataFrame, terms: DataFrame, max_phrase: int = 3, min_sub: int = 5, sep: str = " ", tokens: str = "tokens", into: str = "matches") -> DataFrame:
    """``rows`` with the matches of the distinct ``terms`` in their ``tokens``, from the left and without overlap: the
    longest phrase of up to ``max_phrase`` tokens (joined by ``sep``) that begins at a token, else the longest term of at
    least ``min_sub`` characters inside a longer token (of equal lengths the smaller term).

    Up to ``MOST_TERMS`` terms one automaton serves every worker; more of them meet the tokens in joins."""
    matcher, distinct, wide = _matcher(terms, max_phrase, min_sub, sep)
    if matcher is None:
        return _joined(rows, distinct, wide, min_sub, sep, tokens, into)

    def find(column: pa.Array) -> pa.Array:
        return matcher(column)

    return rows.withColumn(into, F.arrow_udf(find, _MATCH).asNondeterministic()(F.col(tokens)))


def term_counts(rows: DataFrame, terms: DataFrame, max_phrase: int = 3, min_sub: int = 5, sep: str = " ", key: str = "doc_id") -> DataFrame:
    """(key, term, n): how often each term is matched in each of the rows (key, tokens), as ``with_matches`` finds them.
    They are counted where the row is, and only counts leave it."""
    matcher, distinct, wide = _matcher(terms, max_phrase, min_sub, sep)
    if matcher is None:
        each = _joined(rows.select(key, "tokens"), distinct, wide, min_sub, sep, "tokens", "matches").select(key, F.explode("matches.term").alias("term"))
        return each.groupBy(key, "term").agg(F.count("*").alias("n"))

    def count(column: pa.Array) -> pa.Array:
        return matcher.counts(column)

    counts = F.arrow_udf(count, COUNTS).asNondeterministic()(F.col("tokens"))
    return rows.select(key, counts.alias("_counts")).select(key, F.explode("_counts").alias("c")).select(key, "c.*")


def _joined(rows: DataFrame, terms: DataFrame, max_phrase: int, min_sub: int, sep: str, tokens: str, into: str) -> DataFrame:
    """As ``with_matches`` for terms of any number. Grams are made inside the row, parts once per distinct token, and both
    meet the terms in an equality join; overlaps are settled inside the row again."""
    kept = keep(rows.withColumn("_list", F.monotonically_increasing_id()), "rows")
    n, t = F.size(tokens), F.col(tokens)
    upto = lambda i: F.sequence(F.lit(1), F.least(F.lit(max_phrase), n - i))
    gram = lambda i: F.transform(upto(i), lambda m: F.struct(i.cast("int").alias("pos"), m.cast("int").alias("words"), F.array_join(F.slice(t, i + 1, m), sep, NO_TOKEN).alias("term")))
    grams = kept.where(n > 0).select("_list", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), gram))).alias("g")).select("_list", "g.*")
    hits = grams.join(terms, "term").select("_list", "pos", "words", "term", F.when(F.col("words") > 1, "phrase").otherwise("exact").alias("via"))
    single = kept.select("_list", F.posexplode(tokens).alias("pos", "token")).where(F.length("token") > min_sub)
    starts = F.transform(F.sequence(F.lit(1), F.length("token") - min_sub + 1), lambda i: F.transform(F.sequence(F.lit(min_sub), F.length("token") - i + 1), lambda m: F.substring("token", i, m)))
    parts = single.select("token").distinct().select("token", F.explode(F.array_distinct(F.flatten(starts))).alias("term")).where("term <> token").join(terms, "term")
    inside = parts.groupBy("token").agg(F.min(F.struct((-F.length("term")).alias("n"), "term"))["term"].alias("term"))
    compound = single.join(inside, "token").select("_list", "pos", F.lit(0).alias("words"), "term", F.lit("compound").alias("via"))
    # at one place the most words first, a part last; then from the left
    one = F.struct("pos", (-F.col("words")).alias("order"), F.greatest("words", F.lit(1)).alias("words"), "term", "via")
    every = hits.unionByName(compound).groupBy("_list").agg(F.sort_array(F.collect_list(one)).alias("ms"))
    bare = lambda m: F.struct(m["pos"].alias("pos"), m["words"].alias("words"), m["term"].alias("term"), m["via"].alias("via"))
    end = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1))["pos"] + F.try_element_at(a, F.lit(-1))["words"], F.lit(0))
    settled = F.aggregate("ms", F.array().cast(_MATCH), lambda a, m: F.when(m["pos"] >= end(a), F.concat(a, F.array(bare(m)))).otherwise(a))
    out = kept.join(every.select("_list", settled.alias(into)), "_list", "left").drop("_list")
    return out.withColumn(into, F.coalesce(into, F.array().cast(_MATCH)))


def with_evidence(rows: DataFrame, tokens: str = "tokens", matches: str = "matches", into: str = "evidence") -> DataFrame:
    """``rows`` with multiplier and negated of each of their ``matches``, in the same order.

    A modifier waits for the next term however far, one right after a term counts for it as well and then waits
    for the next; a negator reaches ``SCOPE`` tokens; a token inside a match is neither."""

    def weigh(column: pa.Array, found: pa.Array) -> pa.Array:
        return _weigh(_Lists(column), found)

    return rows.withColumn(into, F.arrow_udf(weigh, "array<struct<multiplier:double,negated:boolean>>").asNondeterministic()(F.col(tokens), F.col(matches)))


def term_matches(rows: DataFrame, terms: DataFrame, max_phrase: int = 3, min_sub: int = 5, sep: str = " ", key: str = "doc_id") -> DataFrame:
    """(key, pos, words, term, via): the matches of rows (key, tokens), as ``with_matches`` finds them, one a row."""
    found = with_matches(rows.select(key, "tokens"), terms, max_phrase, min_sub, sep)
    return found.select(key, F.explode("matches").alias("m")).select(key, "m.*")


def weighed(rows: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, term, base, negated, multiplier, score): what each match of rows (key, tokens, matches) contributes by
    its polarity in ``terms``."""
    both = with_evidence(rows.select(key, "tokens", "matches"))
    each = both.select(key, F.explode(F.arrays_zip("matches", "evidence")).alias("x"))
    hits = each.select(key, "x.matches.pos", "x.matches.term", "x.evidence.negated", "x.evidence.multiplier")
    return _scored(hits, terms).select(key, "pos", "term", "base", "negated", "multiplier", "score")


def _scored(hits: DataFrame, terms: DataFrame) -> DataFrame:
    """``hits`` (term, negated, multiplier, ...) with their polarity in ``terms`` as base, and score."""
    rows = hits.withColumn("multiplier", F.round("multiplier", 6)).join(terms.select("term", F.col("polarity").alias("base")), "term")
    score = F.col("base") * F.col("multiplier") * F.when(F.col("negated"), FLIPPED).otherwise(1.0)
    return rows.withColumn("score", F.round(score, 6))


def sentiment_evidence(rows: DataFrame, terms: DataFrame, max_phrase: int = 3, min_sub: int = 5, sep: str = " ", key: str = "doc_id") -> DataFrame:
    """As ``weighed`` for rows (key, tokens)."""
    return weighed(with_matches(rows.select(key, "tokens"), terms, max_phrase, min_sub, sep), terms, key)


def lexicon_sentiment(docs: DataFrame, evidence: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, total, sentiment, confidence, positive, neutral, negative) of every row of ``docs`` (key, words):
    contributions summed, each as often as ``evidence`` says (n) or once, neutral within the band, and a softmax over the
    three. A document without words is neutral for certain."""
    times = (F.col("n") if "n" in evidence.columns else F.lit(1)).cast("decimal(18,0)")
    score = (F.col("score").cast("decimal(18,6)") * times).cast("decimal(28,6)")
    total = evidence.groupBy(key).agg((F.sum(score).cast("double") + 0.0).alias("total"))  # no negative zero
    rows = docs.select(key, "words").join(total, key, "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    t = F.col("total")
    logit = {"positive": SCALE * t, "neutral": SCALE * CALM * (BAND - F.abs(t)), "negative": -SCALE * t}
    top = F.greatest(*logit.values())
    e = {k: F.exp(v - top) for k, v in logit.items()}
    all_ = e["positive"] + e["neutral"] + e["negative"]
    label = F.when(F.abs(t) < BAND, "neutral").when(t > 0, "positive").otherwise("negative")
    for k in logit:
        rows = rows.withColumn(k, F.when(F.col("words") > 0, F.round(e[k] / all_, 6)).otherwise(1.0 if k == "neutral" else 0.0))
    sure = F.when(label == "neutral", F.col("neutral")).when(label == "positive", F.col("positive")).otherwise(F.col("negative"))
    return rows.select(key, "total", label.alias("sentiment"), sure.alias("confidence"), "positive", "neutral", "negative")
