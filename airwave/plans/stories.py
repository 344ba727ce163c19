"""Registered story segmentation with its DuckDB twins: each step's SQL builds on the one before."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from airwave.operators import joins, segment, windows
from airwave.plans.catalog import _BLOCKS, _DEEP, _ENDS, _SIMILAR, _cues, register
from airwave.sources.files import keep

MIN_MS = 60_000

_TOPICS = """bt AS (SELECT video_id, block, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+|\\p{So}')) AS token FROM b WHERE usable),
th AS (SELECT video_id, block, topic_ord, sum(CAST(weight AS DECIMAL(18, 6))) AS score FROM bt JOIN t_terms ON token = term GROUP BY ALL),
tb AS (SELECT *, row_number() OVER (PARTITION BY video_id, block ORDER BY score DESC, topic_ord) AS r, sum(score) OVER (PARTITION BY video_id, block) AS total, coalesce(sum(CASE WHEN topic_ord = 14 THEN score END) OVER (PARTITION BY video_id, block), 0) AS own FROM th),
topics AS (SELECT b.video_id, b.block, CAST(CASE WHEN x.score IS NULL OR x.score < 0.9 THEN 14 ELSE x.topic_ord END AS INT) AS topic, CASE WHEN x.score IS NULL THEN CAST(1 AS DOUBLE) ELSE (CAST(CASE WHEN x.score < 0.9 THEN x.own ELSE x.score END AS DOUBLE) + CAST(0.02 AS DOUBLE)) / (CAST(x.total AS DOUBLE) + CAST(0.3 AS DOUBLE)) END AS confidence
 FROM b LEFT JOIN tb x ON x.video_id = b.video_id AND x.block = b.block AND x.r = 1 WHERE b.usable) """
_FOUND = f"""{_BLOCKS}, {_TOPICS}, c AS (SELECT video_id, block, token AS term, count(*) AS n FROM bt WHERE length(token) > 1 GROUP BY ALL), gr AS (SELECT video_id, block AS gap FROM b), {_SIMILAR}, {_DEEP},
ts AS (SELECT video_id, block, CASE WHEN lag(topic) OVER w = lead(topic) OVER w AND topic <> lag(topic) OVER w THEN lag(topic) OVER w ELSE topic END AS smoothed FROM topics WINDOW w AS (PARTITION BY video_id ORDER BY block)),
tc AS (SELECT video_id, block FROM (SELECT *, lag(smoothed) OVER w AS bf, lead(smoothed) OVER w AS af FROM ts WINDOW w AS (PARTITION BY video_id ORDER BY block)) WHERE smoothed <> bf AND smoothed = af),
hits AS (SELECT video_id, gap AS block, 'lexical-cohesion' AS reason FROM dips UNION ALL SELECT video_id, block, 'topic-change' FROM tc UNION ALL SELECT video_id, block, 'music-break' FROM b WHERE block > 0 AND non_speech_ms >= 4000),
fh AS (SELECT video_id, block, list_sort(list(reason)) AS reasons FROM hits GROUP BY ALL),
us AS (SELECT b.video_id, h.similarity, row_number() OVER (PARTITION BY b.video_id ORDER BY h.similarity) AS r, count(*) OVER (PARTITION BY b.video_id) AS n FROM b JOIN h ON h.video_id = b.video_id AND h.gap = b.block WHERE b.usable AND b.block > 0),
md AS (SELECT video_id, similarity AS middle FROM us WHERE r = n // 2 + 1), lg AS (SELECT video_id FROM b GROUP BY 1 HAVING max(block) >= 2),
bounds AS (SELECT fh.video_id, fh.block, fh.block * 30000 AS at_ms, reasons, least(1.0, 0.34 * len(reasons))::DOUBLE AS confidence FROM fh JOIN lg ON lg.video_id = fh.video_id JOIN h ON h.video_id = fh.video_id AND h.gap = fh.block LEFT JOIN md ON md.video_id = fh.video_id
 WHERE NOT (len(reasons) = 1 AND reasons[1] = 'topic-change' AND h.similarity > coalesce(middle, 0))) """


def _blocks(v):
    return segment.build_blocks(_cues(v))


def _found(v, cues=None):
    return keep(segment.find_boundaries(cues or keep(_cues(v), "cues"), v("t_terms")), "found")


@register("block_topics", f"{_BLOCKS}, {_TOPICS} SELECT * FROM topics")
def _(v):
    return segment.block_topics(_blocks(v), v("t_terms"))


@register("detect_boundaries", _FOUND + "SELECT video_id, block, at_ms, array_to_string(reasons, '+') AS reasons, round(confidence, 6) AS confidence FROM bounds")
def _(v):
    return _found(v).select("video_id", "block", "at_ms", F.array_join("reasons", "+").alias("reasons"), F.round("confidence", 6).alias("confidence"))


#: candidates within half a block, their contexts of 45 s, and the walk that keeps the order
_REFINED = _FOUND.replace("WITH e AS", "WITH RECURSIVE e AS", 1) + """, nr AS (SELECT bo.video_id, bo.block, bo.at_ms AS coarse, e.* EXCLUDE (video_id) FROM bounds bo JOIN e ON e.video_id = bo.video_id AND e.start_ms BETWEEN greatest(0, bo.at_ms - 15000) AND bo.at_ms + 15000),
mu AS (SELECT video_id, coarse, arg_max(end_ms, cue_idx) AS music FROM nr WHERE non_speech GROUP BY ALL),
sp AS (SELECT *, count(*) OVER (PARTITION BY video_id, coarse) AS cnt FROM nr WHERE NOT non_speech AND text <> ''),
cd AS (SELECT sp.video_id, sp.coarse, sp.cue_idx, sp.start_ms AS cut, sp.speaker_change FROM sp LEFT JOIN mu ON mu.video_id = sp.video_id AND mu.coarse = sp.coarse WHERE cnt >= 2 AND mu.music IS NULL),
ct AS (SELECT video_id, cue_idx, start_ms, end_ms, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+|\\p{So}'), lambda t: length(t) > 1)) AS term FROM e WHERE NOT non_speech AND text <> ''),
cc AS (SELECT cd.video_id, cd.cut, ct.term, count(*) FILTER (ct.start_ms < cd.cut AND ct.end_ms > cd.cut - 45000) AS l, count(*) FILTER (ct.start_ms < cd.cut + 45000 AND ct.end_ms > cd.cut) AS r FROM (SELECT DISTINCT video_id, cut FROM cd) cd JOIN ct ON ct.video_id = cd.video_id AND ct.start_ms < cd.cut + 45000 AND ct.end_ms > cd.cut - 45000 GROUP BY ALL),
cs AS (SELECT video_id, cut, 1 - CAST(sum(l * r) AS DOUBLE) / sqrt(CAST(sum(l * l) AS DOUBLE) * CAST(sum(r * r) AS DOUBLE)) AS apart FROM cc GROUP BY ALL HAVING sum(l * l) > 0 AND sum(r * r) > 0),
cb AS (SELECT cd.video_id, cd.coarse, cd.cut, cd.speaker_change, row_number() OVER (PARTITION BY cd.video_id, cd.coarse ORDER BY round(apart + CASE WHEN speaker_change THEN CAST(0.12 AS DOUBLE) ELSE 0 END, 9) DESC, cd.cue_idx) AS r FROM cd JOIN cs ON cs.video_id = cd.video_id AND cs.cut = cd.cut),
rf AS (SELECT bo.*, coalesce(mu.music, cb.cut, bo.at_ms) AS ms, CASE WHEN mu.music IS NOT NULL THEN 'music-cut' WHEN cb.cut IS NULL THEN 'grid' WHEN cb.speaker_change THEN 'speaker-cut' ELSE 'lexical-cut' END AS why, row_number() OVER (PARTITION BY bo.video_id ORDER BY bo.at_ms) AS rn
 FROM bounds bo LEFT JOIN mu ON mu.video_id = bo.video_id AND mu.coarse = bo.at_ms LEFT JOIN cb ON cb.video_id = bo.video_id AND cb.coarse = bo.at_ms AND cb.r = 1),
wk AS (SELECT video_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS last, CAST(NULL AS BIGINT) AS at, CAST(NULL AS VARCHAR) AS refined FROM (SELECT DISTINCT video_id FROM rf) UNION ALL
 SELECT rf.video_id, rf.rn, greatest(wk.last, CASE WHEN rf.ms > wk.last THEN rf.ms ELSE rf.at_ms END), CASE WHEN rf.ms > wk.last THEN rf.ms WHEN rf.at_ms > wk.last THEN rf.at_ms END, CASE WHEN rf.ms > wk.last THEN rf.why ELSE 'grid' END FROM wk JOIN rf ON rf.video_id = wk.video_id AND rf.rn = wk.rn + 1),
moved AS (SELECT rf.video_id, rf.block, rf.reasons, rf.confidence, rf.at_ms AS coarse_ms, wk.at AS at_ms, wk.refined FROM rf JOIN wk ON wk.video_id = rf.video_id AND wk.rn = rf.rn WHERE wk.at IS NOT NULL) """


def _moved(v):
    """The refined boundaries, and the cues that they were found in, written once."""
    cues = keep(_cues(v), "cues")
    return keep(segment.refine_boundaries(_found(v, cues), cues), "moved"), cues


@register("refine_boundaries", _REFINED + "SELECT video_id, block, coarse_ms, at_ms, refined FROM moved")
def _(v):
    return _moved(v)[0].select("video_id", "block", "coarse_ms", "at_ms", "refined")


_SPANS = _REFINED + """, fe AS (SELECT video_id, max(end_ms) AS fin FROM e GROUP BY 1 HAVING max(end_ms) > 0), ca AS (SELECT video_id, at_ms AS start_ms FROM moved UNION SELECT video_id, 0 FROM fe),
spans AS (SELECT * FROM (SELECT ca.video_id, ca.start_ms, coalesce(lead(ca.start_ms) OVER (PARTITION BY ca.video_id ORDER BY ca.start_ms), fin) AS end_ms FROM ca JOIN fe ON fe.video_id = ca.video_id) WHERE start_ms < end_ms) """
#: left fold of spans sp (video_id, start_ms, end_ms, rn): a span joins the open one where either is short
_FOLD = """fd AS (SELECT video_id, rn, start_ms AS s, end_ms AS e FROM sr WHERE rn = 1 UNION ALL SELECT sr.video_id, sr.rn, CASE WHEN sr.end_ms - sr.start_ms < {least} OR fd.e - fd.s < {least} THEN fd.s ELSE sr.start_ms END, sr.end_ms FROM fd JOIN sr ON sr.video_id = fd.video_id AND sr.rn = fd.rn + 1),
merged AS (SELECT video_id, s AS start_ms, max(e) AS end_ms FROM fd GROUP BY ALL) """


@register("spans_from_boundaries", _SPANS + "SELECT * FROM spans")
def _(v):
    moved, cues = _moved(v)
    return segment.spans_from_boundaries(moved, cues.groupBy("video_id").agg(F.max("end_ms").alias("end_ms")).where("end_ms > 0"))


@register("merge_short_spans", "WITH RECURSIVE o AS (SELECT DISTINCT stream_id AS video_id, offset_ms AS start_ms FROM t_messages), sr AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_ms) AS rn FROM (SELECT *, lead(start_ms) OVER (PARTITION BY video_id ORDER BY start_ms) AS end_ms FROM o) WHERE end_ms IS NOT NULL), " + _FOLD.replace("{least}", str(3 * joins.DAY)) + "SELECT * FROM merged")
def _(v):
    w = W.partitionBy("stream_id").orderBy("offset_ms")
    spans = v("t_messages").select("stream_id", "offset_ms").distinct().select(F.col("stream_id").alias("video_id"), F.col("offset_ms").alias("start_ms"), F.lead("offset_ms").over(w).alias("end_ms"))
    return windows.merge_short_spans(spans.where("end_ms is not null"), 3 * joins.DAY)


_STORIES = _SPANS + ", sr AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_ms) AS rn FROM spans), " + _FOLD.replace("{least}", str(MIN_MS)) + """,
said2 AS (SELECT m.video_id, m.start_ms, m.end_ms, string_agg(e.text, '' ORDER BY e.cue_idx) AS text FROM merged m JOIN e ON e.video_id = m.video_id AND NOT e.non_speech AND e.text <> '' AND e.start_ms < m.end_ms AND e.end_ms > m.start_ms GROUP BY ALL),
stories AS (SELECT s.video_id, row_number() OVER (PARTITION BY s.video_id ORDER BY s.start_ms) - 1 AS position, s.start_ms, s.end_ms, s.text, CASE WHEN mv.at_ms IS NULL THEN 'programme-start' ELSE array_to_string(list_append(mv.reasons, mv.refined), '+') END AS reasons, round(coalesce(mv.confidence, 1.0), 6) AS confidence
 FROM said2 s LEFT JOIN moved mv ON mv.video_id = s.video_id AND mv.at_ms = s.start_ms WHERE length(s.text) >= 40) """


def _stories(moved, cues):
    ends = cues.groupBy("video_id").agg(F.max("end_ms").alias("end_ms")).where("end_ms > 0")
    spans = windows.merge_short_spans(segment.spans_from_boundaries(moved, ends), MIN_MS)
    return segment.assemble_segments(spans, moved, cues)


@register("assemble_segments", _STORIES + "SELECT video_id, position, start_ms, end_ms, sha256(text) AS text_sha256, reasons, confidence FROM stories")
def _(v):
    out = _stories(*_moved(v))
    return out.select("video_id", "position", "start_ms", "end_ms", F.sha2("text", 256).alias("text_sha256"), F.array_join("reasons", "+").alias("reasons"), F.round("confidence", 6).alias("confidence"))


#: neighbours of which more than half of the (fewer) six best words are the same
_ALIKE = """, kt AS (SELECT video_id, position, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+|\\p{So}'), lambda t: length(t) >= 2)) AS token FROM stories),
kc AS (SELECT video_id, position, token, count(*) AS occ FROM kt GROUP BY ALL), ks AS (SELECT *, round(CAST(occ AS DOUBLE) / sum(occ) OVER (PARTITION BY video_id, position) * (1 + least(length(token), 12) / CAST(12 AS DOUBLE)), 6) AS score FROM kc),
kk AS (SELECT video_id, position, token FROM (SELECT *, row_number() OVER (PARTITION BY video_id, position ORDER BY score DESC, token) AS r FROM ks) WHERE r <= 6), kn AS (SELECT video_id, position, count(*) AS n FROM kk GROUP BY ALL),
sh AS (SELECT a.video_id, a.position, count(*) AS same FROM kk a JOIN kk b ON b.video_id = a.video_id AND b.position = a.position + 1 AND b.token = a.token GROUP BY ALL),
alike AS (SELECT sh.video_id, count(*) AS alike FROM sh JOIN kn x ON x.video_id = sh.video_id AND x.position = sh.position JOIN kn y ON y.video_id = sh.video_id AND y.position = sh.position + 1 WHERE 2 * same > least(x.n, y.n) GROUP BY 1) """


@register("boundary_report", _STORIES + _ALIKE + """, rr AS (SELECT *, abs(at_ms - coarse_ms) AS m, row_number() OVER (PARTITION BY video_id ORDER BY abs(at_ms - coarse_ms), at_ms) AS r, count(*) OVER (PARTITION BY video_id) AS n FROM moved)
 SELECT video_id, count(*) AS boundaries, count(*) FILTER (list_contains(reasons, 'lexical-cohesion')) AS lexical_cohesion, count(*) FILTER (list_contains(reasons, 'topic-change')) AS topic_change, count(*) FILTER (list_contains(reasons, 'music-break')) AS music_break, count(*) FILTER (refined = 'music-cut') AS music_cut, count(*) FILTER (refined = 'speaker-cut') AS speaker_cut, count(*) FILTER (refined = 'lexical-cut') AS lexical_cut,
 round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END), 6) AS off_grid, max(m) FILTER (r = n // 2 + 1) AS median_shift_ms, coalesce(any_value(alike), 0) AS alike FROM rr LEFT JOIN alike USING (video_id) GROUP BY 1""")
def _(v):
    moved, cues = _moved(v)
    stories = keep(_stories(moved, cues), "stories")
    return segment.boundary_report(moved, segment.story_keywords(stories, 6))


@register("segment_programmes", _STORIES + "SELECT video_id, position, start_ms, end_ms, length(text) AS chars, reasons FROM stories")
def _(v):
    out = segment.segment_programmes(_cues(v), v("t_terms"), MIN_MS)
    return out.select("video_id", "position", "start_ms", "end_ms", F.length("text").cast("long").alias("chars"), F.array_join("reasons", "+").alias("reasons"))


@register("split_mixed_spans")
def _(v):
    cues = _cues(v)
    whole = cues.groupBy("video_id").agg(F.lit(0).cast("long").alias("start_ms"), F.max("end_ms").alias("end_ms")).where("end_ms > 0")
    return segment.split_mixed_spans(whole, cues, segment.cue_terms(cues), lambda said: segment.block_topics(said, v("t_terms")), MIN_MS, apart=0.3)
