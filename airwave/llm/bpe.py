"""Byte-level BPE by merge replay: encode and decode whole texts by a rank file.

The distinct pre-tokens of a block of documents are laid end to end. An inverted index maps a
token pair (named by its rank) to the positions where it stands; merges are applied in rank order,
each one to all of its positions at once, and only the pairs to the left and right of a merged
position are looked up again. Units that the worker's table holds are not replayed.

Defined cases: a null text counts as empty; an empty text has no ids; a repeated row is encoded
like any other; other columns of the input are left out; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import heapq
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .pieces import STEP, Units, gather, slices

NONE = np.int32(2**31 - 1)


class MergeReplay:
    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern).findall
        keys, vals = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    vals.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.vals = np.array(keys, np.int64)[order], np.array(vals, np.int32)[order]
        # ranks whose token can enter a merge that ranks below its own: such a merge goes before a second use of the rank
        after = np.maximum(self.keys >> 32, self.keys & 0xFFFFFFFF)
        self.early = set(after[self.vals < after].tolist())
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        top = max(self.ranks.values()) + 1
        words: list[bytes] = [b""] * top
        for token, rank in self.ranks.items():
            words[rank] = token
        self.blob = np.frombuffer(b"".join(words), np.uint8)
        self.lens = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.units = Units(self.learn, True)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.vals[at], NONE)

    def replay(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens one after the other, and how many each has."""
        if not tokens:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        lens = np.array([len(t) for t in tokens], np.int64)
        tok = self.byte[np.frombuffer(b"".join(tokens), np.uint8)]
        n = len(tok)
        ends = np.cumsum(lens)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[ends - 1] = -1
        prv[ends - lens] = -1
        cur = np.full(n, NONE, np.int32)
        inner = np.flatnonzero(nxt >= 0)
        cur[inner] = self.rank_of(tok[inner], tok[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def post(at: np.ndarray) -> None:
            r = cur[at]
            at, r = at[r != NONE], r[r != NONE]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for key, part in zip(r[np.r_[0, cuts]].tolist(), np.split(at, cuts)):
                if key in index:
                    index[key].append(part)
                else:
                    index[key] = [part]
                    heapq.heappush(heap, key)

        post(inner)
        while heap:
            rank = heapq.heappop(heap)
            parts = index.pop(rank)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[cur[at] == rank]
            if len(parts) == 1 and len(at) > 1 and (at[1:] <= at[:-1]).any():
                at = np.unique(at)
            if not len(at):
                continue
            if rank in self.early and len(at) > 1:
                word = np.searchsorted(ends, at, "right")
                again = np.r_[False, word[1:] == word[:-1]]
                if again.any():  # the first place of each word now, the others after what it may give rise to
                    post(at[again])
                    at = at[~again]
            if len(at) > 1 and (touch := nxt[at[:-1]] == at[1:]).any():  # a a a: pairs that overlap merge from the left
                start = np.r_[True, ~touch]
                first = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            right = nxt[at]
            after = nxt[right]
            tok[at] = rank
            tok[right] = -1
            cur[right] = NONE
            nxt[at] = after
            has = after >= 0
            prv[after[has]] = at[has]
            cur[at] = NONE
            cur[at[has]] = self.rank_of(tok[at[has]], tok[after[has]])
            before = prv[at]
            with_left = before >= 0
            left = before[with_left]
            cur[left] = self.rank_of(tok[left], tok[at[with_left]])
            post(np.concatenate([left, at[has]]) if len(left) else at[has])
        alive = tok >= 0
        return tok[alive].astype(np.uint32), np.diff(np.r_[0, np.cumsum(alive)[ends - 1]])

    def learn(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Replay the merges over the distinct pre-tokens of units that are not known yet."""
        split = [self.find(u) for u in units]
        distinct = list(set(chain.from_iterable(split)))
        ids, n = self.replay([t.encode() for t in distinct])
        number = dict(zip(distinct, range(len(distinct))))
        flat = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64)
        ids, ends = gather(ids, np.cumsum(n) - n, n, flat)
        count = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        return ids, np.diff(np.r_[0, np.r_[0, ends][count]])

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids end."""
        return self.units.encode(texts)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gather(self.blob, self.starts, self.lens, ids)


_open: dict[tuple[str, str], MergeReplay] = {}


def _coder(path: str, pattern: str) -> MergeReplay:
    if (path, pattern) not in _open:
        _open[path, pattern] = MergeReplay(path, pattern)
    return _open[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, decode: bool = False) -> DataFrame:
    """One row per input row: doc_id, ids array<int>; with ``decode`` also the bytes that the ids stand for."""

    def run(batches):
        import pyarrow as pa

        coder = _coder(path, pattern)
        for part in slices(batches, "text", STEP):
            every, stops = coder.encode_batch(part.column("text").to_pylist())
            stops = np.r_[0, stops]
            for at in range(0, part.num_rows, 512):
                ends = stops[at : at + 513] - stops[at]
                flat = every[stops[at] : stops[at] + ends[-1]].astype(np.int32)
                if len(flat) >= 2**31 - 1:
                    raise ValueError("more ids than one Arrow list column holds")
                cols = [part.column("doc_id").slice(at, len(ends) - 1).combine_chunks(), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]
                names = ["doc_id", "ids"]
                if decode:
                    data, stop = coder.decode(flat)
                    stop = np.r_[0, stop]
                    cut = stop[ends]
                    raw = data.tobytes()
                    cols.append(pa.array([raw[a:b] for a, b in zip(cut[:-1], cut[1:])], pa.binary()))
                    names.append("decoded")
                cols[0] = cols[0].cast(pa.int64())
                yield from pa.table(cols, names).to_batches()

    return common.texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>" + ", decoded binary" * decode)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, decoded binary of rows (doc_id, ids); null ids count as none."""

    def run(batches):
        import pyarrow as pa

        coder = _coder(path, pattern)
        for batch in batches:
            rows = [coder.decode(np.array(x or [], np.int64))[0].tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    both = encode(common.read(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, decode=True)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
