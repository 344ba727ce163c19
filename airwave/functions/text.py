"""Column functions over text; each is a JVM expression but for the dictionary tokenizer."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: the clean-up rules in their order, with what a text has to hold for one to apply; a link may hold what looks
#: like a mention, and laughter is a run of digits
_STRIP = (
    (r"<[^>]+>", " ", "<"), (r"&(?:[a-zA-Z]+|#\d+);", " ", "&"), (r"(?i)(?:https?://|www\.)\S+", " ", ("://", "w.", "W.")), (r"(?U)@[\w.\-]+", " ", "@"),
    ("[\u200b-\u200f\u202a-\u202e\ufeff\u00ad]", "", "\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\ufeff\u00ad"),
)
_SQUEEZE = (
    ("\u0e46{2,}", "\u0e46"), (r"(?<![\d,.])(\d)\1{2,}(?![\d,.])", "$1"), (r"(\p{L})\1{2,}", "$1"), (r"(?U)([^\w\s])\1+", "$1"),
)
LAUGHTER = "5{3,}"
#: characters of the Thai script
THAI = "\u0e00-\u0e7f"
#: fixed values: the canonical order of Thai marks. A doubled SARA E is SARA AE; NIKHAHIT and SARA AA are SARA AM; vowels
#: above and below come before tone marks, SARA AM and the vowels that follow come after them; repeated marks are one
_THAI_ORDER = (
    ("\u0e40\u0e40", "\u0e41"), ("\u0e4d([\u0e48-\u0e4b]?)\u0e32", "$1\u0e33"), ("([\u0e48-\u0e4b])\u0e4d\u0e32", "$1\u0e33"),
    ("([\u0e48-\u0e4c]+)([\u0e31\u0e34-\u0e3a\u0e47]+)", "$2$1"), ("([\u0e30\u0e32\u0e33\u0e45]+)([\u0e48-\u0e4b]+)", "$2$1"),
    ("([\u0e30-\u0e3a\u0e40-\u0e45\u0e47-\u0e4e])\\1+", "$1"),
)


def nfkc(col: Column) -> Column:
    """Compatibility forms by Unicode's NFKC, with the collation library that the JVM side has loaded; plain ASCII, which
    they leave as it is, is not sent through it."""
    normal = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), col, F.lit(True))
    return F.when(F.rlike(col, F.lit(r"[^\x00-\x7F]")), normal).otherwise(col)


def ordered_marks(col: Column) -> Column:
    """Thai marks in their canonical order, each once in a row."""
    for pattern, to in _THAI_ORDER:
        col = F.regexp_replace(col, pattern, to)
    return col


def _where(col: Column, test: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """``change`` of a value where ``test`` holds, else the value; it is made once for both."""
    return F.get(F.transform(F.array(col), lambda x: F.when(test(x), change(x)).otherwise(x)), F.lit(0))


def _holds(*marks: str) -> Callable[[Column], Column]:
    return lambda x: reduce(Column.__or__, (F.contains(x, F.lit(m)) for m in marks))


def clean_text(col: Column, keep_emoji: bool = True) -> Column:
    """Text ready for analysis: compatibility forms, then tags, entities, links and mentions go; zero-width characters
    go; laughter (555...) is kept apart; three or more equal digits that stand alone, three or more equal letters and
    two or more equal marks become one; Thai marks take their order; white space is squeezed. Null stays null."""

    def squeezed(c: Column) -> Column:
        for pattern, to in _SQUEEZE:
            c = _where(c, lambda x, p=pattern: F.rlike(x, F.lit(p)), lambda x, p=pattern, to=to: F.regexp_replace(x, p, to))
        return c

    col = nfkc(col)
    for pattern, to, marks in _STRIP:
        col = _where(col, _holds(*marks), lambda x, p=pattern, to=to: F.regexp_replace(x, p, to))
    # what stands between two bursts of laughter is squeezed by itself
    parts = lambda x: F.when(F.contains(x, F.lit("555")), F.split(x, LAUGHTER)).when(x.isNotNull(), F.array(x))
    col = F.get(F.transform(F.array(col), lambda x: F.array_join(F.transform(parts(x), squeezed), " 555 ")), F.lit(0))
    col = col if keep_emoji else F.regexp_replace(col, r"[\p{So}\p{Sk}]", "")
    col = _where(col, lambda x: F.rlike(x, F.lit(f"[{THAI}]")), ordered_marks)
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def script_ratio(col: Column, letters: str = "a-zA-Z") -> Column:
    """In-script characters over characters that are not white space; 0 for none."""
    seen = F.length(F.regexp_replace(col, r"\s", ""))
    return F.when(seen > 0, F.length(F.regexp_replace(col, f"[^{letters}]", "")) / seen).otherwise(0.0)


def is_noise(col: Column, letters: str = "a-zA-Z", min_ratio: float = 0.2, min_len: int = 2) -> Column:
    """Of cleaned text: too short, without letters, or below 15 characters and hardly in script."""
    ratio, n = script_ratio(col, letters), F.length(col)
    return (n < min_len) | ~F.rlike(col, F.lit(r"\p{L}")) | ((n < 15) & (ratio < min_ratio))


#: words (letters with their marks, and digits) and pictographs
TOKEN = r"[\p{L}\p{M}\p{N}]+|\p{So}"
Tokenizer = Callable[[Column], Column]


def tokenize(col: Column) -> Column:
    """Runs of letters, marks and digits in lower case, and pictographs one by one; white space and punctuation go."""
    return F.regexp_extract_all(F.lower(col), F.lit(f"({TOKEN})"), 1)


def _runs(col: Column, script: str) -> Column:
    """As ``tokenize``, with runs of ``script`` apart from other letters."""
    return F.regexp_extract_all(F.lower(col), F.lit(rf"([{script}]+|(?:(?![{script}])[\p{{L}}\p{{M}}\p{{N}}])+|\p{{So}})"), 1)


def locale_tokenizer(language: str = "th", country: str = "TH", script: str = THAI) -> Tokenizer:
    """Tokens of text whose ``script`` has no blanks between words: its runs are cut by the JVM's word breaks for the
    locale, everything else as ``tokenize`` does."""

    def cut(col: Column) -> Column:
        inner = lambda r: F.when(F.rlike(r, F.lit(f"[{script}]")), F.flatten(F.sentences(r, F.lit(language), F.lit(country)))).otherwise(F.array(r))
        return F.flatten(F.transform(_runs(col, script), inner))

    return cut


#: rows that the dictionary tokenizer has as Python objects at a time
ROWS = 64


def dictionary_tokenizer(words: list[str], script: str = THAI) -> Tokenizer:
    """Tokens of text whose ``script`` has no blanks between words, by a dictionary: of all ways to cover a run with
    words, the one that leaves the fewest characters uncovered, then has the fewest words, then the longer words first.
    A word ends where a cluster does, never before a mark or a following vowel or after a leading one; what no word
    covers stays together. ``words`` goes to every worker, so it is a list of a bounded size."""
    known = Lattice(words)

    def cut(col: Column) -> Column:
        def tokens(lists: pa.Array) -> pa.Array:
            """A few rows at a time: as Python's strings, the tokens of a whole Arrow batch would fill a worker."""
            kind = pa.list_(pa.string())
            few = lambda i: [None if rs is None else [t for r in rs for t in known.cut(r)] for rs in lists.slice(i, ROWS).to_pylist()]
            return pa.chunked_array([pa.array(few(i), kind) for i in range(0, len(lists), ROWS)], kind).combine_chunks()

        return F.arrow_udf(tokens, "array<string>")(_runs(col, script))

    return cut


class Lattice:
    """Shortest paths over dictionary words, which a trie finds from every place at once."""

    #: fixed values: Thai vowels that follow their consonant and those that are written before it
    AFTER, BEFORE = frozenset("\u0e30\u0e32\u0e33\u0e45"), frozenset("\u0e40\u0e41\u0e42\u0e43\u0e44")

    def __init__(self, words: list[str]):
        self.root: dict = {}
        for word in words:
            node = self.root
            for ch in word.lower():
                node = node.setdefault(ch, {})
            node[""] = True
        self.letters = {ch for word in words for ch in word.lower()}

    def _breaks(self, run: str) -> list[bool]:
        import unicodedata

        inside = [unicodedata.category(c)[0] == "M" or c in self.AFTER for c in run]
        return [True, *(not inside[i] and run[i - 1] not in self.BEFORE for i in range(1, len(run))), True]

    def cut(self, run: str) -> list[str]:
        if not self.letters.intersection(run):
            return [run]
        n, breaks = len(run), self._breaks(run)
        best: list = [None] * n + [(0, 0)]  # uncovered characters and words from here on
        step = [0] * n
        for i in range(n - 1, -1, -1):
            if not breaks[i]:
                continue
            j = i + 1
            while not breaks[j]:
                j += 1
            best[i], step[i] = (best[j][0] + j - i, best[j][1] + 1), -j
            node, k = self.root, i
            while k < n and (node := node.get(run[k])) is not None:
                k += 1
                # among equals the longer word, which is found later
                if "" in node and breaks[k] and (best[k][0], best[k][1] + 1) <= best[i]:
                    best[i], step[i] = (best[k][0], best[k][1] + 1), k
        out, i, open_ = [], 0, False
        while i < n:
            j = abs(step[i])
            if step[i] < 0 and open_:
                out[-1] += run[i:j]
            else:
                out.append(run[i:j])
            open_, i = step[i] < 0, j
        return out


def sentence_split(col: Column, unmarked: str | None = None) -> Column:
    """Line feeds are hard boundaries; . ! ? end a sentence; pieces are trimmed and empty ones go. In the script
    ``unmarked``, which ends its sentences with a blank, a blank between two of its characters is a boundary as well."""
    parts = F.split(col, r"[.!?\n]" if unmarked is None else rf"[.!?\n]|(?<=[{unmarked}])\s+(?=[{unmarked}])")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def kept_tokens(tokens: Column, stop: list[str], protected: list[str] = (), min_len: int = 2, drop_numbers: bool = True) -> Column:
    """Tokens without stop words, short ones, numbers and what holds no letter or digit; protected words stay."""

    def keep(t: Column) -> Column:
        fine = ~t.isin(stop) & (F.length(t) >= min_len) & F.rlike(t, F.lit(r"[\p{L}\p{N}]"))
        fine = fine & ~F.rlike(t, F.lit(r"^\p{Nd}+$")) if drop_numbers else fine
        return fine | t.isin([*protected]) if protected else fine

    return F.filter(tokens, keep)


def kept_words(words: pa.Array, stop: list[str], protected: list[str] = (), letters: str | None = None) -> np.ndarray:
    """Which of ``words``, distinct tokens, ``kept_tokens`` keeps; of those the ones in script where ``letters`` are given."""
    of = lambda pattern: pc.match_substring_regex(words, pattern)
    fine = [pc.invert(pc.is_in(words, value_set=pa.array([*stop], pa.string()))), pc.greater_equal(pc.utf8_length(words), 2), of(r"[\p{L}\p{N}]"), pc.invert(of(r"^\p{Nd}+$"))]
    kept = reduce(pc.and_, [*fine, of(f"[{letters}]")] if letters else fine)
    return pc.or_(kept, pc.is_in(words, value_set=pa.array([*protected], pa.string()))).to_numpy(zero_copy_only=False)


def keyword_candidates(tokens: Column, stop: list[str], exclude: list[str] = (), letters: str = "a-zA-Z", min_len: int = 2) -> Column:
    """Tokens that may become keywords: filtered without protecting any, in script, and not excluded."""
    fine = lambda t: F.rlike(t, F.lit(f"[{letters}]")) & ~t.isin([*exclude, ""])
    return F.filter(kept_tokens(tokens, stop, min_len=min_len), fine)


def word_ngrams(tokens: Column) -> Column:
    """Tokens and their a_b pairs."""
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("_"), b))
    return F.concat(tokens, pairs)


def char_wb_ngrams(tokens: Column, lo: int = 2, hi: int = 4) -> Column:
    """Character n-grams of lo to hi letters inside each word, which has a blank on either side; a word shorter than n
    gives itself once."""

    def grams(t: Column) -> Column:
        padded = F.concat(F.lit(" "), t, F.lit(" "))
        size = F.length(padded)
        of = lambda n: F.when(size > n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(padded, i, F.lit(n))))
        short = F.array(padded)
        parts = [F.coalesce(of(n), F.when(size == n, short), short if n == lo else F.array().cast("array<string>")) for n in range(lo, hi + 1)]
        return F.concat(*parts)

    return F.flatten(F.transform(tokens, grams))


def find_in_order(text: str, tokens) -> list[int]:
    """Place of each token in ``text``, searched from the end of the one before; where it is not found, that end."""
    out, at = [], 0
    for t in tokens:
        place = text.find(t, at)
        out.append(place if place >= 0 else at)
        at = out[-1] + len(t)
    return out


def token_offsets(text: Column, tokens: Column) -> Column:
    """As ``find_in_order``, in Arrow batches: each search starts where the one before ended, which as a fold of the JVM
    copies all places found so far at every token."""
    from pyspark.sql.functions import PandasUDFType, pandas_udf

    def places(texts, lists):
        import pandas as pd

        return pd.Series([None if s is None or ts is None else find_in_order(s, ts) for s, ts in zip(texts, lists)])

    return pandas_udf(places, "array<int>", PandasUDFType.SCALAR)(text, tokens)


def video_id_from(col: Column) -> Column:
    """The 11-character id of a watch, live, embed, shorts or short link, or a bare id; null otherwise."""
    found = F.regexp_extract(col, r"(?:[?&]v=|/live/|/embed/|/shorts/|youtu\.be/)([A-Za-z0-9_-]{11})(?:[^A-Za-z0-9_-]|$)", 1)
    bare = F.regexp_extract(F.trim(col), r"^([A-Za-z0-9_-]{11})$", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.nullif(bare, F.lit("")))


def require_video_id(col: Column) -> Column:
    """As ``video_id_from``, but a value without an id fails the query."""
    found = video_id_from(col)
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no video id in: "), F.coalesce(col, F.lit("null")))))


#: name of a stream without a usable title
NAMELESS = "Live chat"


def tidy_title(col: Column, cap: int = 48) -> Column:
    """A stream's title without livestream decoration and quotes, shortened; ``NAMELESS`` where nothing is left."""
    c = F.regexp_replace(F.coalesce(col, F.lit("")), "(?i)(?:^|\\s)(?:\U0001f534|\u2b55|\U0001f7e2|\u25b6\ufe0f?|LIVE\\s*!*\\s*:?|สด\\s*:|ถ่ายทอดสด\\s*:)+", " ")
    c = F.regexp_replace(F.regexp_replace(c, "[\"“”]", ""), r"\s{2,}", " ")
    c = F.regexp_replace(c, "^[ :|\\-–—#']+|[ :|\\-–—#']+$", "")
    c = F.when(F.length(c) > cap, F.concat(F.rtrim(F.substring(c, 1, cap)), F.lit("…"))).otherwise(c)
    return F.when(c == "", NAMELESS).otherwise(c)


def window_title(start: Column, stream_title: Column, keywords: Column, count: Column, cap: int = 160) -> Column:
    """k1 · k2 · k3 · k4 — title (stamp), or without keywords the title with stamp and size."""
    stamp, base = F.date_format(start, "dd MMM HH:mm"), tidy_title(stream_title)
    lead = F.array_join(F.slice(F.coalesce(keywords, F.array().cast("array<string>")), 1, 4), " · ")
    plain = F.concat(base, F.lit(" — "), stamp, F.lit(" ("), count.cast("string"), F.lit(" messages)"))
    title = F.when(lead != "", F.concat(lead, F.lit(" — "), base, F.lit(" ("), stamp, F.lit(")"))).otherwise(plain)
    return F.when(F.length(title) > cap, F.concat(F.rtrim(F.substring(title, 1, cap - 1)), F.lit("…"))).otherwise(title)


def clean_cue_text(col: Column) -> Column:
    """struct(text, non_speech, speaker_change) of a caption: a leading >> marks another speaker, bracketed marks of up
    to 24 characters are not speech, and a caption of nothing else is non-speech."""
    c = F.regexp_replace(F.coalesce(col, F.lit("")), "\u00a0", " ")
    said = F.regexp_replace(c, r"^\s*>>\s*", "")
    plain = F.trim(F.regexp_replace(F.regexp_replace(said, r"\[[^\]]{1,24}\]", ""), r"\s+", " "))
    return F.struct(plain.alias("text"), (F.rlike(said, F.lit(r"\[[^\]]{1,24}\]")) & (plain == "")).alias("non_speech"), F.rlike(c, F.lit(r"^\s*>>")).alias("speaker_change"))


_QUOTES = "[\"'“”‘’「」\\s]+"
#: scripts that a headline in the wanted script never holds
FOREIGN = "[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\u0400-\u04ff]"


def clean_headline(col: Column, cap: int = 120, letters: str = "A-Za-z", foreign: str = FOREIGN, labels: str = "headline|title|summary", preamble: str = "(?:this|the) (?:text|story|clip|article) (?:is about|talks about|reports)") -> Column:
    """A model's answer as a bare headline: first line with content, without surrounding quotes, its own label and a
    preamble, capped; null where nothing is left, a foreign script shows or no letter of the wanted script does."""
    bare = lambda c: F.regexp_replace(c, f"^{_QUOTES}|{_QUOTES}$", "")
    line = bare(F.regexp_replace(F.regexp_extract(F.coalesce(col, F.lit("")), r"([^\n]*\S[^\n]*)", 1), r"\s+", " "))
    line = bare(F.regexp_replace(line, f"^(?i:{labels})\\s*[:：]\\s*", ""))
    line = bare(F.regexp_replace(line, f"^(?i:{preamble})\\s*", ""))
    short = F.when(F.length(line) > cap, F.concat(F.rtrim(F.substring(line, 1, cap - 1)), F.lit("…"))).otherwise(line)
    return F.when(F.rlike(line, F.lit(f"[{letters}]")) & ~F.rlike(line, F.lit(foreign)), short)


def apply_corrections(text: Column, pairs: Column) -> Column:
    """``text`` with each pair's ``asr`` replaced by its ``fixed``, the longest first."""
    ordered = F.array_sort(F.filter(F.transform(pairs, lambda p: F.struct((-F.length(p["asr"])).alias("n"), p["asr"].alias("asr"), p["fixed"].alias("fixed"))), lambda p: p["asr"] != ""))
    return F.aggregate(F.coalesce(ordered, F.array().cast("array<struct<n:int,asr:string,fixed:string>>")), F.coalesce(text, F.lit("")), lambda t, p: F.replace(t, p["asr"], p["fixed"]))


def normalise_label(col: Column, aliases: dict[str, str], fallback: str) -> Column:
    """The label that a slug, name or alias in any case stands for, else the fallback."""
    c = F.lower(F.trim(col))
    by: dict[str, list[str]] = {}
    for alias, label in aliases.items():
        by.setdefault(label, []).append(alias.lower())
    out = F.lit(None).cast("string")
    for label, known in by.items():
        out = F.when(c.isin(known), label).otherwise(out)
    return F.coalesce(out, F.lit(fallback))


def normalise_topic(col: Column, topics: dict[str, list[str]], fallback: str = "other") -> Column:
    """``topics``: slug -> its names in any language."""
    return normalise_label(col, {name: slug for slug, names in topics.items() for name in (slug, *names)}, fallback)


#: fixed values: spellings of the three sentiments
SENTIMENT_ALIASES = {"positive": "positive", "pos": "positive", "neutral": "neutral", "neu": "neutral", "negative": "negative", "neg": "negative", "บวก": "positive", "กลาง": "neutral", "ลบ": "negative", "1": "positive", "0": "neutral", "-1": "negative"}


def normalise_sentiment(col: Column) -> Column:
    return normalise_label(col, SENTIMENT_ALIASES, "neutral")


def utc_datetime(col: Column) -> Column:
    """An ISO date or time as a timestamp: a date alone is its midnight, the offset may be hours alone, and what has no
    zone is UTC, whatever the session's zone; null if it is none."""
    c = F.trim(col)
    dated = F.when(F.rlike(c, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.concat(c, F.lit("T00:00:00"))).otherwise(c)
    for part in (r"\d{2}", r"\d{2}:\d{2}"):  # hours, or hours and minutes, may stand alone
        dated = F.regexp_replace(dated, rf"^([^Tt ]+[Tt ]{part})(?![:\d])", "$1:00")
    timed = F.rlike(dated, F.lit(r"^[^Tt ]+[Tt ].*(?:[Zz]|[+-]\d{2}(?::?\d{2})?)$"))
    zoned = F.when(F.rlike(dated, F.lit(r"[Tt ].*[+-]\d{2}$")), F.concat(dated, F.lit(":00"))).when(timed, dated).otherwise(F.concat(dated, F.lit("Z")))
    return F.try_to_timestamp(zoned)


def usec_to_datetime(col: Column) -> Column:
    """Microseconds since 1970, as text or number; what is none becomes the time of reading."""
    return F.coalesce(F.timestamp_micros(col.try_cast("bigint")), F.current_timestamp())
