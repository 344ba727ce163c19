"""Operators against plain loops that follow the written rules, on random inputs and the named edge cases."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from airwave.functions import privacy, text
from airwave.operators import evaluation, filters, lexicon, models, segment, stages, stats, texts, windows
from airwave.sources import files


def cosine(a, b):
    d = sum(a[t] * b[t] for t in a)
    return d / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())) if d else 0.0


def test_cohesion_and_depth_equal_loops(spark):
    rnd = random.Random(1)
    terms, grid, sims, depths = [], [], {}, {}
    for video in range(12):
        n = rnd.choice([1, 2, 5, 20])
        words = [[rnd.choice("abcdefg") * 2 for _ in range(rnd.randint(0, 4))] for _ in range(n)]
        grid += [(video, i) for i in range(n)]
        terms += [(video, i, t) for i in range(n) for t in words[i]]
        s = [1.0] + [round(cosine(Counter(t for w in words[max(0, g - 3) : g] for t in w), Counter(t for w in words[g : g + 3] for t in w)), 6) for g in range(1, n)]
        d = [0.0] * n
        for i in range(1, n - 1):
            left = right = i
            while left > 0 and s[left - 1] >= s[left]:
                left -= 1
            while right < n - 1 and s[right + 1] >= s[right]:
                right += 1
            d[i] = s[left] - s[i] + s[right] - s[i]
        sims |= {(video, g): s[g] for g in range(n)}
        depths |= {(video, g): round(d[g], 5) for g in range(n)}
    got = segment.cohesion(spark.createDataFrame(grid, "video_id long, block long"), spark.createDataFrame(terms, "video_id long, block long, term string"))
    rows = windows.depth_scores(got).collect()
    assert {(r["video_id"], r["gap"]): r["similarity"] for r in rows} == pytest.approx(sims, abs=2e-6)
    assert {(r["video_id"], r["gap"]): round(r["depth"], 5) for r in rows} == pytest.approx(depths, abs=3e-5)


CUES = "video_id long, cue_idx long, start_ms long, end_ms long, text string, non_speech boolean, speaker_change boolean"


def test_blocks_are_dense(spark):
    cues = [(1, 0, 0, 10_000, "a" * 50, False, False), (1, 1, 20_000, 35_000, "", True, False), (1, 2, 100_000, 100_000, "b", False, False), (1, 3, 120_000, 120_000, "c", False, False), (1, 4, 130_000, 131_000, "d", False, False), (2, 0, 0, 0, "x", False, False)]
    got = [tuple(r)[1:] for r in segment.build_blocks(spark.createDataFrame(cues, CUES)).where("video_id = 1").orderBy("block").collect()]
    assert got == [
        (0, 0, 30_000, "a" * 50, 50, 15_000, True), (1, 30_000, 60_000, "", 0, 15_000, False), (2, 60_000, 90_000, "", 0, 0, False),
        (3, 90_000, 120_000, "b", 1, 0, False), (4, 120_000, 131_000, "d", 1, 0, False),
    ]
    assert segment.build_blocks(spark.createDataFrame(cues, CUES)).where("video_id = 2").count() == 0


def test_refinement_equals_loop(spark):
    rnd, cues, bounds, want = random.Random(3), [], [], {}
    for video in range(8):
        at, mine = 0, []
        for i in range(60):
            long = rnd.randint(2000, 9000)
            quiet = rnd.random() < 0.06
            mine.append((video, i, at, at + long, "" if quiet else " ".join(rnd.choice("abcdefgh") * 2 for _ in range(4)), quiet, rnd.random() < 0.2))
            at += long
        cues += mine
        coarse = sorted(rnd.sample(range(30_000, at, 30_000), min(6, at // 30_000 - 1)))
        bounds += [(video, c, c // 30_000) for c in coarse]
        last = 0
        for c in coarse:
            lo, hi = max(0, c - 15_000), c + 15_000
            near = [q for q in mine if lo <= q[2] <= hi]
            music, spoken = [q for q in near if q[5]], [q for q in near if not q[5] and q[4]]
            ms, why = c, "grid"
            if music:
                ms, why = music[-1][3], "music-cut"
            elif len(spoken) >= 2:
                best = -1.0
                for q in spoken:
                    side = lambda a, b: Counter(t for x in mine if not x[5] and x[2] < b and x[3] > a for t in x[4].split())  # noqa: B023, E731
                    l, r = side(q[2] - 45_000, q[2]), side(q[2], q[2] + 45_000)
                    if l and r:
                        score = round(1 - cosine(l, r) + (0.12 if q[6] else 0.0), 9)
                        if score > best:
                            best, ms, why = score, q[2], "speaker-cut" if q[6] else "lexical-cut"
            if ms <= last:
                ms, why = c, "grid"
            if ms > last:
                want[video, c], last = (ms, why), ms
    rows = spark.createDataFrame(cues, CUES)
    got = segment.refine_boundaries(spark.createDataFrame(bounds, "video_id long, at_ms long, block long"), rows, segment.cue_terms(rows)).collect()
    assert {(r["video_id"], r["coarse_ms"]): (r["at_ms"], r["refined"]) for r in got} == want
    assert {w for _, w in want.values()} >= {"music-cut", "lexical-cut", "speaker-cut"}


def test_stories_and_mixed_spans(spark):
    one, two = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    cues = [(1, i, i * 10_000, i * 10_000 + 10_000, (one if i < 30 else two), False, False) for i in range(60)]
    rows = spark.createDataFrame(cues, CUES)
    terms = spark.createDataFrame([("alpha", 0, 1.0), ("one", 1, 1.0)], "term string, topic_ord int, weight double")
    spans = spark.createDataFrame([(1, 0, 600_000)], "video_id long, start_ms long, end_ms long")
    out = segment.split_mixed_spans(spans, rows, segment.cue_terms(rows), lambda said: segment.block_topics(said, terms))
    assert sorted(tuple(r)[1:] for r in out.collect()) == [(0, 300_000), (300_000, 600_000)]
    stories = segment.segment_programmes(rows, terms, split=True).orderBy("position").collect()
    assert [r["position"] for r in stories] == [*range(len(stories))] and stories[0]["reasons"] == ["programme-start"] and stories[0]["confidence"] == 1.0
    assert any(r["start_ms"] == 300_000 for r in stories)
    assert segment.segment_programmes(rows.limit(0), terms).count() == 0


def loop_sentiment(tokens, terms):
    """The state machine over single-word terms."""
    total, until, wait, out = 0.0, -1, 1.0, []
    for i, t in enumerate(tokens):
        if t not in terms:
            if t in lexicon.NEGATORS:
                until = i + 3
            else:
                wait *= lexicon.MODIFIERS.get(t, 1.0)
            continue
        wait *= lexicon.MODIFIERS.get(tokens[i + 1], 1.0) if i + 1 < len(tokens) else 1.0
        value = terms[t] * wait * (-0.8 if i <= until else 1.0)
        out.append((i, t, round(wait, 6), i <= until, round(value, 6)))
        total, wait = total + value, 1.0
    return total, out


def test_sentiment_equals_the_state_machine(spark):
    rnd = random.Random(5)
    terms = {"good": 1.0, "bad": -1.0, "fine": 0.2, "not": 0.1}
    words = [*terms, "no", "non", "very", "so", "slightly", "x", "y"]
    docs = {d: [rnd.choice(words) for _ in range(rnd.randint(0, 25))] for d in range(60)}
    tokens = spark.createDataFrame([*docs.items()], "doc_id long, tokens array<string>")
    weights = spark.createDataFrame([*terms.items()], "term string, polarity double")
    evidence = lexicon.sentiment_evidence(tokens, weights)
    got = defaultdict(list)
    for r in evidence.orderBy("doc_id", "pos").collect():
        got[r["doc_id"]].append((r["pos"], r["term"], r["multiplier"], r["negated"], r["score"]))
    frame = spark.createDataFrame([(d, len(ts)) for d, ts in docs.items()], "doc_id long, words int")
    verdict = {r["doc_id"]: r for r in lexicon.lexicon_sentiment(frame, evidence).collect()}
    assert len(verdict) == len(docs)
    for d, ts in docs.items():
        total, rows = loop_sentiment(ts, terms)
        assert [x[:2] + x[3:4] for x in got[d]] == [x[:2] + x[3:4] for x in rows]
        assert [x[2] for x in got[d]] == pytest.approx([x[2] for x in rows], abs=1e-5) and [x[4] for x in got[d]] == pytest.approx([x[4] for x in rows], abs=1e-5)
        v = verdict[d]
        assert v["total"] == pytest.approx(total, abs=1e-4)
        assert v["positive"] + v["neutral"] + v["negative"] == pytest.approx(1, abs=1e-5)
        if not ts:
            assert (v["sentiment"], v["confidence"]) == ("neutral", 1.0)
        elif abs(abs(total) - 0.35) > 1e-3:
            assert v["sentiment"] == ("neutral" if abs(total) < 0.35 else "positive" if total > 0 else "negative")


@pytest.mark.parametrize("most", [1 << 18, 2])
def test_matches_do_not_overlap(spark, monkeypatch, most):
    """By the automaton, and by joins for terms beyond its bound."""
    monkeypatch.setattr(lexicon, "MOST_TERMS", most)
    terms = {"a", "a b", "b c d", "c", "inside", "side", "d"}
    rnd = random.Random(6)
    docs = {d: [rnd.choice(["a", "b", "c", "d", "insides", "x"]) for _ in range(rnd.randint(0, 30))] for d in range(40)}
    want = []
    for d, ts in docs.items():
        i = 0
        while i < len(ts):
            for n in (3, 2, 1):
                if i + n <= len(ts) and " ".join(ts[i : i + n]) in terms:
                    want.append((d, i, n, " ".join(ts[i : i + n]), "exact" if n == 1 else "phrase"))
                    i += n
                    break
            else:
                if ts[i] == "insides":
                    want.append((d, i, 1, "inside", "compound"))
                i += 1
    tokens = spark.createDataFrame([*docs.items(), (50, None), (51, [None, "a", None])], "doc_id long, tokens array<string>").repartition(3)
    want.append((51, 1, 1, "a", "exact"))
    got = lexicon.term_matches(tokens, spark.createDataFrame([(t,) for t in terms], "term string")).collect()
    assert sorted((r["doc_id"], r["pos"], r["words"], r["term"], r["via"]) for r in got) == sorted(want)


def test_topic_falls_back_with_its_own_probability(spark):
    terms = spark.createDataFrame([("w", 1, 0.5), ("s", 2, 2.0), ("s", 3, 2.0), ("f", 14, 0.4)], "term string, topic_ord int, weight double")
    hits = spark.createDataFrame([(1, "w"), (2, "s"), (3, "w"), (3, "f")], "doc_id long, term string")
    docs = spark.createDataFrame([(i,) for i in range(1, 5)], "doc_id long")
    got = {r["doc_id"]: (r["topic_ord"], r["confidence"]) for r in stats.gazetteer_topic(docs, hits, terms).collect()}
    assert {k: (t, round(c, 6)) for k, (t, c) in got.items()} == {1: (14, 0.025), 2: (2, round(2.02 / 4.3, 6)), 3: (14, round(0.42 / 1.2, 6)), 4: (14, 1.0)}


def test_sentiment_shares_are_zero_filled(spark):
    rows = lambda xs: [(r["sentiment"], r["n"], r["percentage"]) for r in stats.by_sentiment(spark.createDataFrame([(x,) for x in xs], "sentiment string")).orderBy("ord").collect()]
    assert rows(["negative", "negative", None]) == [("positive", 0, 0.0), ("neutral", 0, 0.0), ("negative", 2, 66.7)]
    assert rows([]) == [("positive", 0, 0.0), ("neutral", 0, 0.0), ("negative", 0, 0.0)]


def test_every_author_and_handle_gets_a_pseudonym(spark):
    rows = [("Somchai Jaidee", "hi @alice-bob, @a.b_c and @ab"), ("@alice-bob", None), (None, ""), ("", "x@y.z")]
    once = privacy.pseudonymise(spark.createDataFrame(rows, "author string, text string"), "s")
    got = once.collect()
    assert got[0]["author"].startswith("viewer #") and "Somchai" not in got[0]["author"]
    assert "alice" not in got[0]["text"] and "-bob" not in got[0]["text"] and got[0]["text"].endswith("and @ab")
    assert got[1]["author"][-8:] in got[0]["text"] and got[2]["author"] is None and got[3]["author"] == ""
    assert privacy.pseudonymise(once, "s").collect() == got
    docs = spark.createDataFrame([(1, "t @someone", None, "s @someone")], "id long, title string, content string, summary string")
    made = privacy.pseudonymise_documents(docs, "s").first()
    assert "someone" not in made["title"] + made["summary"] and made["content"] is None
    audit = privacy.privacy_audit(spark.createDataFrame([(1, "call 123456789"), (2, "=== 000000000"), (3, "by @viewer-0a1b2c3d"), (4, "by @raw")], "id long, content string"))
    assert sorted((r["id"], r["digit_runs"], r["handles"]) for r in audit.collect()) == [(1, 1, 0), (4, 0, 1)]
    idf = spark.createDataFrame([("@raw", 1), ("word", 2), ("@viewer-1", 1)], "term string, df long")
    assert [r["term"] for r in privacy.vocabulary_audit(idf).collect()] == ["@raw"]


def test_cleaning_keeps_numbers_and_laughter(spark):
    given = {"250,000 in 2000": "250,000 in 2000", "11111": "1", "5555 ok": "555 ok", "sooooo good!!!!": "so good!", "ＡＢＣ１": "ABC1", "a\u200bb": "ab", "<i>x</i>&#39;y www.a.b/c @z-1": "x y", "  a \n b ": "a b", "\u0e2a\u0e39\u0e49\u0e46\u0e46\u0e46": "\u0e2a\u0e39\u0e49\u0e46"}
    rows = spark.createDataFrame([(k,) for k in given], "t string")
    assert {r[0]: r[1] for r in rows.select("t", text.clean_text(F.col("t"))).collect()} == given
    exact = spark.createDataFrame([("ﬁne ①",)], "t string").select(text.clean_text(F.col("t"))).first()[0]
    assert exact == "fine 1"
    assert spark.createDataFrame([("hi 😀",)], "t string").select(text.clean_text(F.col("t"), keep_emoji=False)).first()[0] == "hi"


def test_scalar_columns(spark):
    one = lambda value, f, kind="string": spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t"))).first()[0]
    assert one("  >> [music] \n", text.clean_cue_text).asDict() == {"text": "", "non_speech": True, "speaker_change": True}
    assert one(">> hello [laughs] you", text.clean_cue_text).asDict() == {"text": "hello you", "non_speech": False, "speaker_change": True}
    assert one("\n \"Headline: The story is about rain\"\nmore", text.clean_headline) == "rain"
    assert one("Headline:", text.clean_headline) is None and one("政坛对峙", text.clean_headline) is None and one(None, text.clean_headline) is None
    assert one("🔴 LIVE!! : \"Morning\" show |", text.tidy_title) == "Morning show" and one("LIVE", text.tidy_title) == "Live chat" and one(None, text.tidy_title) == "Live chat"
    assert one(["ab", "c"], lambda c: text.char_wb_ngrams(c, 2, 4), "array<string>") == [" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "]
    assert one("a bb  a", lambda c: text.token_offsets(c, F.array(F.lit("a"), F.lit("bb"), F.lit("zz"), F.lit("a")))) == [0, 2, 4, 6]
    assert one("Politik", lambda c: text.normalise_topic(c, {"politics": ["politik"]})) == "politics" and one(None, lambda c: text.normalise_topic(c, {"politics": []})) == "other"
    assert one("NEG", text.normalise_sentiment) == "negative" and one("?", text.normalise_sentiment) == "neutral"
    with pytest.raises(Exception, match="no video id"):
        one("https://e.org/page", text.require_video_id)
    assert one(["a", "12", "x", "ok", "--"], lambda c: text.kept_tokens(c, ["ok"], ["x"]), "array<string>") == ["x"]


def loop_summary(body, stop, lo=2, hi=4):
    import re

    pool = [s.strip(" ") for s in re.split(r"[.!?\n]", body)]
    pool = [s for s in pool if s]
    pool = [s for s in pool if len(s) >= 12] or pool
    if len(pool) <= lo:
        return " ".join(pool)
    sets = [{t for t in re.split(r"[^a-z]+", s.lower()) if len(t) > 1 and t not in stop} for s in pool]
    df, n = Counter(t for s in sets for t in s), len(pool)
    score = []
    for i, s in enumerate(sets):
        c = sum(sum(math.log((1 + n) / (1 + df[t])) + 1 for t in s & o) / math.sqrt(len(s) * len(o)) for j, o in enumerate(sets) if j != i and o and s) / max(n - 1, 1)
        score.append(round(c + 0.35 * (1 - i / n), 9) if s else 0.0)
    best = sorted(sorted(range(n), key=lambda i: (-score[i], i))[: max(lo, min(hi, n))])
    return " ".join(pool[i] for i in best)


def test_summary_equals_loop(spark):
    rnd, stop = random.Random(8), ["the", "of"]
    words = "the of rain storm city flood river bridge closed open mayor said people moved school".split()
    docs = {d: ". ".join(" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(0, 12))) for d in range(40)}
    docs[99] = ""
    got = {r["doc_id"]: r["summary"] for r in texts.extractive_summary(spark.createDataFrame([*docs.items()], "doc_id long, text string"), stop).collect()}
    assert got == {d: loop_summary(t, stop) for d, t in docs.items()}


def test_headline_equals_loop(spark):
    rnd, stop, filler, edge = random.Random(9), ["the", "of"], ["well", "uh"], ["and", "to"]
    words = [*stop, *filler, *edge, "rain", "storm", "city", "2024", "flood", "river", "mayor", "bridge", "people"]
    docs, want = [], {}
    for d in range(30):
        ts = [rnd.choice(words) for _ in range(rnd.randint(0, 40))]
        body, kw = "  ".join(ts), rnd.sample(["rain", "mayor", "absent"], rnd.randint(0, 2))
        offs, at = [], 0
        for t in ts:
            offs.append(body.find(t, at))
            at = offs[-1] + len(t)
        offs.append(len(body))
        cs = rnd.sample(offs[:-1], min(3, len(ts)))
        docs.append((d, body, kw, cs))
        best, span = -math.inf, None
        for s in range(len(ts)):
            if ts[s] in edge or ts[s] in filler:
                continue
            for m in range(7, 21):
                if s + m > len(ts) or offs[s + m] - offs[s] > 85:
                    break
                win = ts[s : s + m]
                inner = [t for t in win if len(t) > 1 and t.isalpha() and t not in stop + filler]
                hits = {*inner} & {*kw}
                if len(inner) < 4 or kw and not hits:
                    continue
                score = len({*inner}) + 2.5 * len(hits) + 2 * (ts[s] in kw) - 1.2 * sum(t in filler for t in win) - 0.6 * sum(t.isdigit() for t in win) + 3 * (offs[s] in cs)
                score = round(score / math.sqrt(m) - 1.2 * s / len(ts), 9)
                if score > best:
                    best, span = score, (s, s + m)
        want[d] = ""
        if span:
            a, b = span
            while b > a and (ts[b - 1] in edge or ts[b - 1] in filler):
                b -= 1
            want[d] = " ".join(body[offs[a] : offs[b]].split())
    got = texts.extract_headline(spark.createDataFrame(docs, "doc_id long, text string, keywords array<string>, cue_starts array<int>"), None, 0, stop, filler, edge).collect()
    assert {r["doc_id"]: r["headline"] for r in got} == want and sum(map(bool, want.values())) > 10


G = texts.Gazetteers(titles=["mr", "dr"], not_person=["viewer"], name_stop=["said"], organisations=["university"], places=["in"], known_places=["rome", "nice"], ambiguous=["nice"], patterns=texts.PATTERNS)


THAI_WORDS = ["รถยนต์", "ชน", "กัน", "กลาง", "สี่", "แยก", "สี่แยก", "มี", "ผู้", "ได้รับ", "บาดเจ็บ", "ราย", "ทีม", "ไทย", "เล่น", "ไม่", "ดี", "เลย", "ครับ", "ชนะ", "แล้ว"]


def test_words_of_scripts_with_and_without_blanks(spark):
    said = {"รถยนต์ชนกันกลางสี่แยก": ["รถยนต์", "ชน", "กัน", "กลาง", "สี่แยก"], "มีผู้ได้รับบาดเจ็บ 5 ราย": ["มี", "ผู้", "ได้รับ", "บาดเจ็บ", "5", "ราย"], "ไทย   ชนะ\n\nแล้ว": ["ไทย", "ชนะ", "แล้ว"], "ทีมไทยเล่นไม่ดีเลยครับ 555": ["ทีม", "ไทย", "เล่น", "ไม่", "ดี", "เลย", "ครับ", "555"], "  \n": [], "Covid19ชนabc": ["covid19", "ชน", "abc"], "ชนฟหกเดแยก": ["ชน", "ฟหกเด", "แยก"], "🧡🧡 x": ["🧡", "🧡", "x"], None: None}
    rows = spark.createDataFrame([(t,) for t in said], "t string")
    cut = text.dictionary_tokenizer(THAI_WORDS)
    assert {r["t"]: r["ts"] for r in rows.select("t", cut(F.col("t")).alias("ts")).collect()} == said
    by_locale = {r["t"]: r["ts"] for r in rows.select("t", text.locale_tokenizer()(F.col("t")).alias("ts")).collect()}
    assert by_locale["ไทย   ชนะ\n\nแล้ว"] == ["ไทย", "ชนะ", "แล้ว"] and by_locale["Covid19ชนabc"] == ["covid19", "ชน", "abc"] and by_locale["🧡🧡 x"] == ["🧡", "🧡", "x"]
    plain = {"covid19 Ça e\u0301te\u0301 555 don't": ["covid19", "ça", "e\u0301te\u0301", "555", "don", "t"], "ไม่ดี": ["ไม่ดี"]}
    rows = spark.createDataFrame([(t,) for t in plain], "t string")
    assert {r["t"]: r["ts"] for r in rows.select("t", text.tokenize(F.col("t")).alias("ts")).collect()} == plain
    long_ = "ฝนตกหนักทำให้เกิดน้ำท่วม ประชาชนได้รับความเดือดร้อน 12 ราย เจ้าหน้าที่เร่งเข้าช่วย"
    parts = spark.createDataFrame([(long_,)], "t string").select(text.sentence_split(F.col("t"), text.THAI)).first()[0]
    assert parts == ["ฝนตกหนักทำให้เกิดน้ำท่วม", "ประชาชนได้รับความเดือดร้อน 12 ราย", "เจ้าหน้าที่เร่งเข้าช่วย"]


def test_lattice_takes_the_best_of_all_ways():
    """Against every way to cover a run with words and single characters."""
    rnd = random.Random(9)

    def ways(run):
        if not run:
            yield []
        for k in range(1, len(run) + 1):
            if run[:k] in words:
                yield from ([(run[:k], True), *rest] for rest in ways(run[k:]))
        if run:
            yield from ([(run[:1], False), *rest] for rest in ways(run[1:]))

    for _ in range(150):
        words = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(6)}
        run = "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 9)))
        best = min(ways(run), key=lambda w: (sum(not known for _, known in w), len(w), [-len(t) if known else 0 for t, known in w]))
        want, open_ = [], False
        for t, known in best:
            if not known and open_:
                want[-1] += t
            else:
                want.append(t)
            open_ = not known
        assert text.Lattice([*words]).cut(run) == want or run == want[0], (words, run)


def test_analysis_in_a_script_without_blanks(spark):
    """Keywords, sentiment, topic, summary and entities stand on the dictionary's words."""
    terms = spark.createDataFrame([("ไม่ดี", 2, 1.0, -1.0), ("ชนะ", 4, 2.0, 1.0)], "term string, topic_ord int, weight double, polarity double")
    docs = spark.createDataFrame([(1, "ทีมไทยชนะแล้ว", "ทีมไทยเล่นดี ทีมไทยชนะแล้วครับ"), (2, None, "ทีมไทยเล่นไม่ดีเลย")], "doc_id long, title string, content string")
    got = {r["doc_id"]: r for r in texts.analyse_documents(docs, terms, ["ครับ"], G, tokenizer=text.dictionary_tokenizer(THAI_WORDS), unmarked=text.THAI, letters=text.THAI, sep="").collect()}
    assert (got[1]["sentiment"], got[1]["topic"], got[2]["sentiment"], got[2]["topic"]) == ("positive", 4, "negative", 2)
    assert {"ทีม", "ไทย", "ชนะ"} <= {k["word"] for k in got[1]["keywords"]} and "ครับ" not in {k["word"] for k in got[1]["keywords"]}
    assert got[1]["summary"] == "ทีมไทยเล่นดี ทีมไทยชนะแล้วครับ"


def test_cleaning_orders_thai_marks(spark):
    given = {"\u0e40\u0e40\u0e01": "\u0e41\u0e01", "\u0e17\u0e4d\u0e32": "\u0e17\u0e33", "\u0e17\u0e33": "\u0e17\u0e33", "\u0e19\u0e48\u0e4d\u0e32": "\u0e19\u0e48\u0e33", "\u0e17\u0e35\u0e48\u0e48": "\u0e17\u0e35\u0e48", "\u0e17\u0e48\u0e35": "\u0e17\u0e35\u0e48", "ดีมากกกกก": "ดีมาก", "ธรรมชาติ": "ธรรมชาติ", "55555ตลก": "555 ตลก", "🧡🧡🧡🧡": "🧡", "ＴＨＡＩ １２３ ﬁ": "THAI 123 fi", "รักเลย 🧡": "รักเลย 🧡"}
    rows = spark.createDataFrame([(k,) for k in given], "t string")
    assert {r[0]: r[1] for r in rows.select("t", text.clean_text(F.col("t"))).collect()} == given


def test_rows_that_share_a_doc_id_are_analysed_each(spark):
    terms = spark.createDataFrame([("flood", 2, 1.0, -1.0), ("great", 4, 1.0, 1.0)], "term string, topic_ord int, weight double, polarity double")
    docs = spark.createDataFrame([(1, "Flood", "A bad flood"), (1, "Great", "A great day"), (None, "x", "y")], "doc_id long, title string, content string")
    got = sorted((r["doc_id"] or 0, r["topic"], r["sentiment"], r["token_count"]) for r in texts.analyse_documents(docs, terms, [], G).collect())
    assert got == [(0, 14, "neutral", 2), (1, 2, "negative", 4), (1, 4, "positive", 4)]
    chat = spark.createDataFrame([("a", "great one"), ("a", "a flood"), ("a", "?")], "doc_id string, text string")
    assert sorted((r["doc_id"], r["is_spam"], r["sentiment"]) for r in texts.score_messages(chat, terms).collect()) == [("a", False, "negative"), ("a", False, "positive"), ("a", True, None)]


def test_entities_and_names(spark):
    said = "Mr Smithsaid and Dr Anna Bell, mr viewer; dr 7 mr. University Hospital nice in nice rome 12 May 2024 at 9:30 paid $5,000 or 3 % for 4 days. Mr Smithsaid"
    got = {(r["text"], r["label"]) for r in texts.entities(spark.createDataFrame([(1, said), (2, ""), (3, None)], "doc_id long, text string"), G).collect()}
    assert {("mr smith and", "PERSON"), ("dr anna bell", "PERSON"), ("university hospital", "ORGANIZATION"), ("rome", "LOCATION"), ("nice", "LOCATION"), ("in nice", "LOCATION"), ("12 May 2024", "DATE"), ("9:30", "TIME"), ("$5,000", "MONEY"), ("3 %", "PERCENT"), ("4 days", "QUANTITY")} >= {x for x in got if x[0] != "mr smithsaid and" and x[1] != "PERSON"}
    assert ("dr anna bell", "PERSON") in got and not any("viewer" in t for t, _ in got)
    names = spark.createDataFrame([("smithsaid",), ("said",), ("x",)], "name string")
    cut = {r["name"]: r["trimmed"] for r in texts.trim_welded_suffix(names, spark.createDataFrame([("said",), ("id",)], "term string")).collect()}
    assert cut == {"smithsaid": "smith", "said": "sa", "x": "x"}
    people = spark.createDataFrame([(1, "mr anna", "PERSON"), (1, "mr annabel", "PERSON"), (1, "rome", "LOCATION"), (2, "dr annaline", "PERSON"), (2, "mr annamoor", "PERSON")], "doc_id long, text string, label string")
    fixed = texts.repair_segment_names(people, spark.createDataFrame([("anna", 9)], "name string, support long"), spark.createDataFrame([("zz",)], "term string"), ["mr", "dr"])
    assert sorted(map(tuple, fixed.collect())) == [(1, "mr anna", "PERSON"), (1, "rome", "LOCATION"), (2, "dr anna", "PERSON"), (2, "mr anna", "PERSON")]


def test_analysis_of_documents(spark):
    terms = spark.createDataFrame([("flood", 2, 1.0, -1.0), ("great", 4, 1.0, 1.0)], "term string, topic_ord int, weight double, polarity double")
    rows = [(1, "Flood news", "The flood came. Very great flood of the river in May. People moved on. Nothing else happened here."), (2, None, None), (3, "", "not great at all")]
    got = {r["doc_id"]: r for r in texts.analyse_documents(spark.createDataFrame(rows, "doc_id long, title string, content string"), terms, ["the", "of"], G).collect()}
    assert (got[1]["topic"], got[1]["sentiment"], got[2]["topic"], got[2]["sentiment"], got[3]["sentiment"]) == (2, "negative", 14, "neutral", "negative")
    assert got[1]["keywords"][0]["word"] == "flood" and got[1]["summary"] and got[2]["summary"] == "" and got[2]["token_count"] == 0
    assert got[1]["model_versions"]["topic"] == stages.RULES["topic"]
    chat = spark.createDataFrame([("a", "great"), ("b", "11111"), ("c", None), ("d", "not great")], "doc_id string, text string")
    assert {r["doc_id"]: (r["is_spam"], r["sentiment"]) for r in texts.score_messages(chat, terms).collect()} == {"a": (False, "positive"), "b": (True, None), "c": (True, None), "d": (False, "negative")}


def test_models_take_over_stages(spark):
    """A model serves its stage, in batches; one that does not open, knows no columns or no name leaves it to the rules."""
    terms = spark.createDataFrame([("flood", 2, 1.0, -1.0)], "term string, topic_ord int, weight double, polarity double")
    docs = spark.createDataFrame([(i, f"t{i}", "a flood") for i in range(7)], "doc_id long, title string, content string")
    opened = []

    def topics():
        opened.append(1)
        return lambda f: f.assign(topic=100 + len(f), topic_confidence=0.5)[["topic", "_row", "topic_confidence"]]

    def broken():
        raise OSError("no weights")

    known = [stages.Stage("topic", "m", topics, batch=3), stages.Stage("sentiment", "gone", broken), stages.Stage("summary", "odd", lambda: lambda f: f), stages.Stage("entities", "short", lambda: lambda f: f.head(0).assign(entities=[]))]
    asked = {"topic": "m", "sentiment": "gone", "summary": "odd", "entities": "short", "keywords": "other"}
    choices = stages.choose(spark, asked, known)
    assert not opened  # it is opened by workers alone
    out = texts.analyse_documents(docs.coalesce(1), terms, [], G, choices=choices)
    rows = out.collect()
    assert {r["topic"] for r in rows} <= {101, 102, 103} and {r["sentiment"] for r in rows} == {"negative"} and all(r["summary"] for r in rows)
    told = {r["stage"]: (r["active"], r["trained"], r["documents"], r["note"]) for r in stages.status(out, choices).collect()}
    assert told["topic"] == ("m", True, 7, None) and told["tokenizer"] == ("words-2", False, 7, None)
    assert told["sentiment"] == ("lexicon-1", False, 7, "OSError: no weights; lexicon-1 serves")
    assert told["summary"][0] == "extractive-1" and "gives no summary" in told["summary"][3] and "row for each document" in told["entities"][3] and "not known" in told["keywords"][3]
    with pytest.raises(ValueError):
        stages.choose(spark, {"topics": "m"})


def test_models_learn_and_are_stored(spark, tmp_path):
    rnd = random.Random(2)
    docs = [(i, " ".join([("rain storm" if i % 2 else "goal match"), *(rnd.choice(["a1", "bb", "cc", "dd"]) for _ in range(5))]), float(i % 2), i % 3) for i in range(60)]
    frame = spark.createDataFrame(docs, "id long, text string, label double, fold int")
    counts = models.term_counts(frame.select("id", "text"))
    vocabulary = models.fit_vectorizer(counts, 60, 2, 200)
    assert vocabulary.where("view = 'word'").count() > 0 and vocabulary.where("view = 'char'").count() > 0
    norms = models.weights(counts, vocabulary).groupBy("id", "view").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert all(abs(r["n"] - 1) < 1e-6 for r in norms)
    rows = models.vectorize(frame, counts, vocabulary).persist()
    for algo in ("logistic", "svm", "bayes"):
        out = models.scores(rows, models.train_classifier(rows, algo, rounds=10)).select("label", "prediction", "p").collect()
        assert all(r["label"] == r["prediction"] and abs(sum(r["p"]) - 1) < 1e-6 for r in out)
    with pytest.raises(ValueError):
        models.estimator("forest", 1)
    model = models.train_classifier(rows, rounds=10)
    told = {r["id"]: r for r in models.predict(rows.withColumn("text", F.when(F.col("id") == 0, " ").otherwise(F.col("text"))), model, ["sport", "weather"], "weather").collect()}
    assert (told[0]["label"], told[0]["confidence"], told[2]["label"]) == ("weather", 1.0, "sport")
    path = str(tmp_path / "m")
    models.save_model(spark, model, path, ["sport", "weather"], {"acc": 1.0})
    again, labels, note = models.load_model(spark, path)
    assert note is None and labels == ["sport", "weather"] and again.coefficients == model.coefficients
    svm = models.train_classifier(rows, "svm", rounds=10)
    models.save_model(spark, svm, str(tmp_path / "svm"), ["sport", "weather"], {})
    again, _, note = models.load_model(spark, str(tmp_path / "svm"))
    p = lambda m: {r["id"]: list(r["p"]) for r in models.scores(rows, m).select("id", "p").collect()}
    before, after = p(svm), p(again)
    assert note is None and len(svm.parts) == 3 and before == after
    assert all(0 < x < 1 and abs(sum(ps) - 1) < 1e-9 for ps in before.values() for x in ps)
    rules = rows.select("id", F.array(F.lit(0.5), F.lit(0.5)).alias("p"))
    best = models.out_of_fold_alpha(rows, rules, 3, [0.0, 1.0], [1.0], rounds=10).first()
    assert (best["alpha"], best["accuracy"]) == (1.0, 1.0)
    assert models.spread([(0, 0.5, 0.2), (1, 1.0, 0.4)]) == {"accuracy_mean": 0.75, "accuracy_deviation": 0.25, "macro_f1_mean": 0.3, "macro_f1_deviation": 0.1}
    (tmp_path / "b" / "about").mkdir(parents=True)
    (tmp_path / "b" / "about" / "part-0.json").write_text("{broken")
    assert models.load_model(spark, str(tmp_path / "b"))[0] is None and models.load_model(spark, str(tmp_path / "none"))[0] is None
    oof = models.out_of_fold(rows, 3, rounds=10).persist()
    assert oof.count() == 60 and [m[1] for m in models.cross_validate(oof, 3)] == [1.0] * 3 and models.cross_validate(oof, 1) == []
    assert models.macro_f1(models.stacking(oof, oof, 3, 10))["accuracy"] == 1.0
    assert models.grid_search(rows, 3, {"bayes": [1.0]}, rounds=5)[0][2] == 1.0
    assert windows.fold_count(frame, "label") == 5


def test_few_discordant_pairs_have_an_exact_p(spark):
    for b, c in ((0, 0), (1, 0), (3, 3), (10, 2), (0, 24), (12, 12)):
        n = b + c
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n)
        rows = [(1, 1, 0)] * b + [(1, 0, 1)] * c + [(1, 1, 1)]
        r = evaluation.mcnemar(spark.createDataFrame(rows, "y_true int, y_a int, y_b int")).first()
        assert (r["only_a"], r["only_b"]) == (b, c) and r["p_value"] == pytest.approx(want, abs=1e-6)


def test_metrics(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(2, 0)]
    rows = spark.createDataFrame(pairs, "y int, p int")
    got = {r["label"]: r for r in evaluation.classification_metrics(evaluation.confusion_matrix(rows, "y", "p", [0, 1, 2])).collect()}
    assert got["accuracy"]["recall"] == round(8 / 11, 6) and got["2"]["f1"] == 0.0
    assert got["macro"]["recall"] == round((5 / 7 + 1) / 3, 6) and got["weighted"]["recall"] == round(8 / 11, 6)
    for x in (0.0, 0.5, 1.0, 2.0):
        assert spark.range(1).select(evaluation.erfc(F.lit(x))).first()[0] == pytest.approx(math.erfc(x), abs=2e-7)
    p = spark.createDataFrame([(1, {"a": 0.2, "b": 0.5, "c": 0.2, "d": 0.05, "e": 0.05})], "id long, probabilities map<string,double>")
    assert [(r["rank"], r["label"]) for r in filters.top_probabilities(p).orderBy("rank").collect()] == [(1, "b"), (2, "a"), (3, "c"), (4, "d")]


def test_readers(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    item = '{"addChatItemAction":{"item":{"liveChatTextMessageRenderer":{"id":"1","timestampUsec":"5","message":{"runs":[{"text":"hi "},{"emoji":{"emojiId":"E","isCustomEmoji":false}}]}}}}}'
    (tmp_path / "raw" / "vid.live_chat.json").write_text("\n".join([item, '{"replayChatItemAction":{"videoOffsetTimeMsec":"x","actions":[' + item + ',{"addLiveChatTickerItemAction":{}}]}}', "[1]", "oops", ""]))
    got = [(r["video_id"], r["text"], r["offset_ms"]) for r in files.read_raw_live_chat(spark, str(tmp_path / "raw")).collect()]
    assert got == [("vid", "hi E", None)] * 2
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "v.json").write_text('{"cues":[{"t":5,"e":9,"x":"b"},{"t":0,"e":4,"x":"","n":true}]}')
    assert [(r["cue_idx"], r["text"], r["non_speech"]) for r in files.read_transcript_snapshots(spark, str(tmp_path / "t")).orderBy("cue_idx").collect()] == [(0, "", True), (1, "b", False)]
    (tmp_path / "a.csv").write_text('title,content,source,url,published_at\nT,"two\nlines",,,2024-01-02T03:04:05\nU,c,s,u,never\n')
    got = [(r["source"], r["content"], r["published_at"] is None) for r in files.read_articles_csv(spark, str(tmp_path / "a.csv")).collect()]
    assert got == [("sample", "two\nlines", False), ("s", "c", True)]


def test_terms_are_counted_where_they_are_matched(spark, monkeypatch):
    r = random.Random(4)
    words = ["ab", "cdefgh", "xxcdefghx", "q", "", "abcdef", None]
    rows = spark.createDataFrame([(i, None if i == 3 else [r.choice(words) for _ in range(r.randint(0, 14))]) for i in range(60)], "doc_id long, tokens array<string>")
    terms = spark.createDataFrame([("ab",), ("cdefgh",), ("ab q",), ("q ab cdefgh",), ("",)], "term string")
    want = Counter((m["doc_id"], m["term"]) for m in lexicon.term_matches(rows, terms).collect())
    assert want and {(c["doc_id"], c["term"]): c["n"] for c in lexicon.term_counts(rows, terms).collect()} == want
    assert lexicon.term_counts(rows, terms.limit(0)).count() == 0
    monkeypatch.setattr(lexicon, "MOST_TERMS", 0)
    assert {(c["doc_id"], c["term"]): c["n"] for c in lexicon.term_counts(rows, terms).collect()} == want


def test_cohesion_of_a_programme_of_many_runs(spark, monkeypatch):
    monkeypatch.setattr(segment, "RUN", 8)
    r = random.Random(5)
    blocks = [[r.choice("abcdefg") for _ in range(r.choice([0, 1, 6]))] for _ in range(75)]
    grid = spark.createDataFrame([(1, b) for b in range(75)], "video_id long, block long")
    terms = spark.createDataFrame([(1, b, t) for b, ts in enumerate(blocks) for t in ts], "video_id long, block long, term string")
    for k in (1, 3):
        got = {x["gap"]: x["similarity"] for x in segment.cohesion(grid, terms, k).collect()}
        for g in range(1, 75):
            left, right = (Counter(t for ts in part for t in ts) for part in (blocks[max(g - k, 0) : g], blocks[g : g + k]))
            norm = math.sqrt(sum(n * n for n in left.values()) * sum(n * n for n in right.values()))
            assert got[g] == pytest.approx(sum(n * right[t] for t, n in left.items()) / norm if norm else 0.0, abs=1e-6)
        assert len(got) == 75 and got[0] == 1.0


def test_report_counts_neighbours_that_share_their_keywords(spark):
    moved = spark.createDataFrame([(1, 30, 0, ["topic-change"], "grid"), (2, 60, 60, ["music-break"], "music-cut")], "video_id long, at_ms long, coarse_ms long, reasons array<string>, refined string")
    stories = [(1, 0, "storm storm rain coast coast"), (1, 1, "storm rain coast harbour"), (1, 2, "vote vote party"), (1, 3, "a b"), (3, 0, "x")]
    words = segment.story_keywords(spark.createDataFrame(stories, "video_id long, position long, text string"), 3)
    said = {(w["video_id"], w["position"]): set(w["keywords"]) for w in words.collect()}
    assert said[1, 0] == {"storm", "rain", "coast"} and said[1, 3] == set() == said[3, 0]
    got = {x["video_id"]: x["alike"] for x in segment.boundary_report(moved, words).collect()}
    assert got == {1: 1, 2: 0}
    assert "alike" not in segment.boundary_report(moved).columns
