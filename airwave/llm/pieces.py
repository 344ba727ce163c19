"""Encoding whole texts through a bounded table of the units that a tokenizer treats independently.

Three kinds of place always separate two pre-tokens of the tokenizers used here: before a single blank
that a visible character follows, between a letter and a following mark, and after a line feed between
two visible characters. A text is cut there on its bytes with numpy; every unit is looked up by a 64-bit
hash of its bytes and length and then compared byte by byte, and only units that the worker's table does
not hold become Python strings and go through the encoder. Should two units share a hash, the table starts
anew with another seed. It is made of arrays, not objects; when it is full it starts anew, which costs
time, never results.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np

from .hashing import concatenate, same_bytes, stretch_hash

#: Units that a worker's table holds, and bytes of text cut at a time.
CACHE, STEP = 2_000_000, 4 << 20

_VISIBLE = np.zeros(256, bool)
_VISIBLE[33:127] = True
#: lead bytes of characters that are never white space
_VISIBLE[[*range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: second bytes, after 0xC3, of the Latin-1 small letters
_SMALL = np.zeros(256, bool)
_SMALL[[*range(0x9F, 0xB7), *range(0xB8, 0xC0)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?|%$#*&\n")] = True


def cut_units(buf: np.ndarray, starts: np.ndarray, blanks_count: bool) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 byte of every unit of the texts in ``buf`` (as ``concatenate`` lays them out), in order.
    With ``blanks_count`` a unit begins with its blank; without, blanks and line feeds belong to none."""
    n = len(buf)
    feeds = starts[1:] - 1  # the line feed after each text belongs to no text
    if not blanks_count:
        inside = (buf != 32) & (buf != 10)
    else:
        inside = np.ones(n, bool)
        inside[feeds] = False
    edge = np.zeros(n + 1, bool)
    edge[:-1] = inside
    edge[1:-1] &= ~inside[:-1]  # where a run begins
    letter = _LETTER[buf]
    letter[1:] |= (buf[:-1] == 0xC3) & _SMALL[buf[1:]]
    begin = edge[:-1]
    begin[1:] |= letter[:-1] & _MARK[buf[1:]] & inside[1:]
    if blanks_count:
        seen = _VISIBLE[buf]
        begin[:-1] |= (buf[:-1] == 32) & seen[1:]
        begin[2:] |= (buf[1:-1] == 10) & seen[2:] & (seen[:-2] & (buf[:-2] < 127) | letter[:-2])
        begin &= inside
    first = np.flatnonzero(begin)
    if blanks_count:
        last = np.r_[first[1:], n]
        stop = feeds[np.searchsorted(feeds, first)]
    else:
        ends = np.flatnonzero(np.r_[inside[:-1] & ~inside[1:], True]) + 1
        last = np.r_[first[1:], n]
        stop = ends[np.searchsorted(ends, first, "right")]
    return first, np.minimum(last, stop)


class Units:
    """``encode(texts)``: the ids of all texts one after the other, and where each text's ids end.
    ``learn`` gives (ids, number of ids of each) of a list of new units."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], blanks_count: bool):
        self.learn, self.blanks_count, self.seed = learn, blanks_count, 0
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.begin, self.stop = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.bytes = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint8)]
        self.total = self.held = 0

    def _add(self, buf: np.ndarray, keys: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        raw = buf.tobytes()
        units = [raw[a:b] for a, b in zip(first.tolist(), last.tolist())]
        ids, n = self.learn([u.decode() for u in units])
        where = np.searchsorted(self.keys, keys)
        stop = self.held + np.cumsum(last - first)
        self.at = np.insert(self.at, where, self.total + np.cumsum(n) - n)
        self.size = np.insert(self.size, where, n)
        self.begin, self.stop = np.insert(self.begin, where, stop - (last - first)), np.insert(self.stop, where, stop)
        self.keys = np.insert(self.keys, where, keys)
        self.ids.append(ids.astype(np.uint32))
        self.bytes.append(np.frombuffer(b"".join(units), np.uint8))
        self.total += len(ids)
        self.held = int(stop[-1]) if len(stop) else self.held

    def _place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def _looked_up(self, buf: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray | None:
        """Where the table has each unit; None if two different units share a hash."""
        keys, one, inverse = np.unique(stretch_hash(buf, first, last, self.seed), return_index=True, return_inverse=True)
        if not same_bytes(buf, first, last, buf, first[one][inverse], last[one][inverse]).all():
            return None
        at, known = self._place(keys)
        if len(self.bytes) > 1:
            self.bytes = [np.concatenate(self.bytes)]
        there, mine = at[known], one[known]
        if not same_bytes(buf, first[mine], last[mine], self.bytes[0], self.begin[there], self.stop[there]).all():
            return None
        if not known.all():
            if len(self.keys) + int((~known).sum()) > CACHE:
                self._clear()
                known[:] = False
            new = one[~known]
            self._add(buf, keys[~known], first[new], last[new])
            at, _ = self._place(keys)
        return at[inverse]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        buf, starts = concatenate(texts)
        first, last = cut_units(buf, starts, self.blanks_count)
        while (own := self._looked_up(buf, first, last)) is None:
            self.seed += 1
            self._clear()
        if len(self.ids) > 1:
            self.ids = [np.concatenate(self.ids)]
        ids, ends = gather(self.ids[0], self.at, self.size, own)
        # units before each text's end
        before = np.searchsorted(first, starts[1:])
        return ids, np.r_[0, ends][before]


def library(path: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Encoder of units by the ``tokenizers`` library; the strings of special tokens in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from itertools import chain

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True

    def learn(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in tok.encode_batch_fast(units, add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum())), n

    return learn


_open: dict[tuple[str, bool], Units] = {}


def units(path: str, blanks_count: bool) -> Units:
    """The worker's own instance; workers are reused, so later tasks find the table warm."""
    key = (path, blanks_count)
    if key not in _open:
        _open[key] = Units(library(path), blanks_count)
    return _open[key]


def slices(batches, column: str, most: int):
    """Cut Arrow batches so that the strings of ``column`` in one slice have ``most`` bytes together
    (a longer text is a slice of its own)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        sizes = sizes.to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        ends = np.cumsum(sizes)
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
            yield pa.Table.from_batches([batch.slice(at, to - at)])
            at = to


def gather(blob: np.ndarray, starts: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of ``blob`` that belong to ``ids``, one after the other, and where each one ends."""
    n = lens[ids]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(starts[ids] - (ends - n), n)
    return blob[shift + np.arange(total)], ends
