"""Tokenizer-based operators against the public libraries."""

import base64
import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from airwave.llm import bpe, packing, pieces, tokenfiles

ODD = ["", None, " ", "a", "a  b", " x\n\ny ", "it's 'sOne two", "tab\tand 　wide", "é combining", "aaaa aaaaaaa", "<|endoftext|> x", "日本語 テスト  ", "end \x1c mark", "word " * 3000]


@pytest.fixture(scope="module")
def documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(150).collect()]
    rows += [(-1 - i, t) for i, t in enumerate(ODD)] + [(None, "no id")]
    return rows


def tokenizer(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return t


def frame(spark, rows):
    return spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, ids string")


def test_bpe_equals_tiktoken(spark, documents):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bpe.encode(frame(spark, documents), path, P.PATTERN, decode=True).collect()}
    for doc, text in documents:
        assert got[doc]["ids"] == enc.encode_ordinary(text or ""), (doc, text)
        assert bytes(got[doc]["decoded"]) == (text or "").encode()
    again = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(bpe.encode(frame(spark, documents), path, P.PATTERN), path, P.PATTERN).collect()}
    assert again == {d: (t or "").encode() for d, t in documents}


def test_bpe_random_words_against_tiktoken():
    """Dense random strings over few letters reach merges whose products rank below them."""
    import random

    import tiktoken

    rnd = random.Random(7)
    for name in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"):
        coder = bpe.MergeReplay(P.path(name), P.PATTERN)
        enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
        words = ["".join(rnd.choice("abeinst ") for _ in range(rnd.randint(1, 40))) for _ in range(3000)]
        words += ["".join(rnd.choice("aé日!1\n ") for _ in range(rnd.randint(1, 40))) for _ in range(3000)]
        words += ["".join(rnd.choice(["ab", "ss", "ti", "on"]) for _ in range(rnd.randint(1, 20))) for _ in range(2000)]
        ids, ends = coder.encode_batch(words)
        for w, a, b in zip(words, [0, *ends], ends):
            assert ids[a:b].tolist() == enc.encode_ordinary(w), w


#: the parity of the ones in each place's number: a polynomial hash modulo 2 ** 64 takes the two for equal
PARITY = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
TWINS = [PARITY, PARITY.translate(str.maketrans("ab", "ba"))]


def test_twins_of_a_polynomial_hash_keep_their_own_ids(spark):
    import tiktoken

    rows, t, u = list(enumerate(TWINS * 2)), tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")
    coder = pieces.units(P.path("byte_bpe_50k.json"), True)
    got, ends = coder.encode(TWINS)
    assert [got[a:b].tolist() for a, b in zip([0, *ends], ends)] == [t.encode(x, add_special_tokens=False).ids for x in TWINS]
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r["doc_id"]: list(r["ids"]) for r in bpe.encode(frame(spark, rows), path, P.PATTERN).collect()} == {d: enc.encode_ordinary(x) for d, x in rows}
    for r in packing.pack(frame(spark, rows), packing.tokenizer_path(), 1, 4096).collect():
        assert list(struct.unpack(f"<{r['length']}I", r["ids"])) == u.encode(rows[r["doc_id"]][1], add_special_tokens=False).ids + [1]


def test_units_that_share_a_hash_are_told_apart(monkeypatch):
    """A hash of two bits: bytes decide, and the table starts anew until no two units meet."""
    from airwave.llm import hashing

    texts = ["one two three", "two four"]
    learn = lambda units: (np.array([len(u) for u in units], np.uint32), np.ones(len(units), np.int64))
    weak = lambda buf, first, last, seed=0: hashing.stretch_hash(buf, first, last, seed) & np.uint64(15)
    monkeypatch.setattr(pieces, "stretch_hash", weak)
    table = pieces.Units(learn, False)
    for _ in range(2):
        ids, ends = table.encode(texts)
        assert ids.tolist() == [3, 3, 5, 3, 4] and ends.tolist() == [3, 5]


def test_same_bytes():
    from airwave.llm import hashing

    buf, starts = hashing.concatenate(["a" * 600 + "b", "a" * 600 + "c", "a" * 600 + "b", "", "xy", "xz"])
    first, last = starts[:-1], starts[1:] - 1
    pairs = [(0, 1), (0, 2), (3, 3), (4, 5), (4, 4), (0, 4)]
    i, j = map(np.array, zip(*pairs))
    assert hashing.same_bytes(buf, first[i], last[i], buf, first[j], last[j]).tolist() == [False, True, True, False, True, False]
    h = hashing.stretch_hash(buf, first, last)
    assert h[0] == h[2] and len({*h.tolist()}) == 5


def test_pack_ranks_in_groups(spark, monkeypatch):
    """Remainders of one length over many groups, and windows of several tasks: every place is taken once."""
    monkeypatch.setattr(packing, "GROUP", 3)
    rows = [(i, "word " * (5 + i % 4)) for i in range(60)] + [(100 + i, "word " * (90 + i)) for i in range(12)]
    out = packing.pack(frame(spark, rows).repartition(5), packing.tokenizer_path(), 1, 32).collect()
    windows = {}
    for r in out:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(windows) == list(range(len(windows)))
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= 32


def test_token_operators_leave_clashing_columns_out(spark):
    rows = spark.createDataFrame([(1, "a b", 9, "x", 3, 4)], "doc_id long, text string, ids long, nth string, _row long, length int")
    assert packing.pack(rows, packing.tokenizer_path(), 1).columns == ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]
    assert packing.pack(rows, packing.tokenizer_path(), 1).count() == 1
    path = P.path("byte_bpe_multi_50k.tiktoken")
    assert bpe.encode(rows, path, P.PATTERN).columns == ["doc_id", "ids"] and bpe.encode(rows.limit(0), path, P.PATTERN).count() == 0


def test_pack(spark, documents):
    t = tokenizer("word_bpe_49k.json")
    out = packing.pack(frame(spark, documents), packing.tokenizer_path(), 1, 256).collect()
    ids = {d: t.encode(x or "", add_special_tokens=False).ids + [1] for d, x in documents}
    pieces = {}
    for r in out:
        assert list(struct.unpack(f"<{r['length']}I", r["ids"])) == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    assert pieces.keys() == ids.keys()
    for d, p in pieces.items():
        at = 0
        for start, n in sorted(p):
            assert start == at
            at += n
        assert at == len(ids[d])
    windows = {}
    for r in out:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= 256
    total = sum(len(x) for x in ids.values())
    assert len(windows) <= total / 256 * 1.02


def test_pack_empty(spark):
    assert packing.pack(frame(spark, []), packing.tokenizer_path(), 1).count() == 0


def test_closest_fill_is_best():
    import itertools
    import random

    rnd = random.Random(5)
    for _ in range(200):
        counts = {rnd.randint(1, 30): rnd.randint(1, 3) for _ in range(rnd.randint(1, 5))}
        cap = rnd.randint(1, 60)
        used = packing.closest_fill(counts, cap)
        assert all(n <= counts[k] for k, n in used.items())
        best = max(s for c in itertools.product(*(range(n + 1) for n in counts.values())) if (s := sum(a * b for a, b in zip(c, counts))) <= cap)
        assert sum(k * n for k, n in used.items()) == best


def test_token_files(spark, documents, tmp_path):
    t = tokenizer("byte_bpe_50k.json")
    path = str(tmp_path / "tokens")
    tokenfiles.write(frame(spark, documents), P.path("byte_bpe_50k.json"), 0, path)
    got = tokenfiles.read(spark, path).collect()
    assert len(got) == len(documents)
    ids = {d: t.encode(x or "", add_special_tokens=False).ids + [0] for d, x in documents}
    at = 0
    for r in sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        assert r["start"] == at and r["n_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(r["ids"]) == zlib.crc32(struct.pack(f"<{r['n_tokens']}I", *ids[r["doc_id"]]))
        at += r["n_tokens"]


def test_token_files_empty(spark, tmp_path):
    path = str(tmp_path / "none")
    tokenfiles.write(frame(spark, []), P.path("byte_bpe_50k.json"), 0, path)
    assert tokenfiles.read(spark, path).count() == 0


def test_values_round_trip():
    import numpy as np

    for n in (0, 1, 3, 4, 1000):
        v = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64) >> np.random.default_rng(n + 1).integers(0, 32, n).astype(np.uint64)
        assert (tokenfiles.decode_values(*tokenfiles.encode_values(v), n) == v).all()


def test_digest_query(spark, sf):
    r = bpe.query(spark, sf).where("doc_id = 0").first()
    text = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id = 0").first()["text"]
    assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
