"""Registered phrase matching, name repair, samples and prediction grids with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from airwave.operators import reports, segment, stats, windows
from airwave.plans.catalog import _AIR, _ENDS, register

#: phrases of one to three words over the documents' common words
PHRASES = ["the", "of", "of the", "in the", "to the", "and", "is", "it", "is it", "of the the", "la", "der"]
ALPHAS, TEMPERATURES = [i / 20 for i in range(21)], [0.5, 0.75, 1.0, 1.5, 2.0]

_PHRASES = ", ".join(f"('{p}')" for p in PHRASES)


@register("term_match_join", f"""WITH g AS (SELECT doc_id, pos, token AS a, lead(token) OVER w AS b, lead(token, 2) OVER w AS c FROM t_tokens WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
 u AS (SELECT doc_id, pos, 1 AS words, a AS term FROM g UNION ALL SELECT doc_id, pos, 2, a || ' ' || b FROM g UNION ALL SELECT doc_id, pos, 3, a || ' ' || b || ' ' || c FROM g),
 m AS (SELECT u.* FROM u JOIN (VALUES {_PHRASES}) p(term) ON u.term = p.term)
 SELECT doc_id, pos, arg_max(term, words) AS term, CAST(max(words) AS INT) AS words FROM m GROUP BY ALL""")
def _(v):
    tokens = v("t_tokens")
    return reports.phrase_matches(tokens, tokens.sparkSession.createDataFrame([(p,) for p in PHRASES], "term string"))


@register("collapse_variants", """WITH b AS (SELECT DISTINCT token AS name FROM t_tokens), k AS (SELECT name, unnest(range(2, length(name))) AS k FROM b),
 p AS (SELECT name, substr(name, 1, k) AS prefix FROM k), a AS (SELECT p.* FROM p JOIN b ON p.prefix = b.name), c AS (SELECT prefix FROM a GROUP BY 1 HAVING count(*) >= 3)
 SELECT name, arg_max(a.prefix, length(a.prefix)) AS body FROM a JOIN c ON a.prefix = c.prefix GROUP BY 1""")
def _(v):
    return reports.collapse_variants(v("t_tokens").select(F.col("token").alias("name")))


@register("correct_names", """WITH l AS (SELECT token AS name, count(*) AS support FROM t_tokens GROUP BY 1), k AS (SELECT name, unnest(range(4, length(name))) AS k FROM l WHERE support < 3 AND length(name) > 4),
 p AS (SELECT name, substr(name, 1, k) AS prefix, substr(name, k + 1) AS rest FROM k)
 SELECT p.name, arg_max(prefix, length(prefix)) AS corrected FROM p JOIN l ON l.name = p.prefix AND l.support >= 3 WHERE rest IN (SELECT token FROM t_tokens WHERE length(token) <= 3) GROUP BY 1""")
def _(v):
    tokens = v("t_tokens")
    lexicon = tokens.groupBy(F.col("token").alias("name")).agg(F.count("*").alias("support"))
    return reports.correct_names(lexicon, tokens.where("length(token) <= 3").select(F.col("token").alias("term")).distinct())


@register("reaction_samples", f"""WITH r AS (SELECT s.segment_id, m.message_id, row_number() OVER (PARTITION BY s.segment_id ORDER BY m.offset_ms, m.message_id) AS n, count(*) OVER (PARTITION BY s.segment_id) AS total {_AIR})
 SELECT segment_id, message_id, n - total // 4 AS nth FROM r WHERE n - total // 4 BETWEEN 1 AND 12""")
def _(v):
    return reports.reaction_samples(v("t_messages"), v("t_segments"))


@register("programme_segments", _ENDS + """, t AS (SELECT video_id, count(*) AS cue_count FROM e GROUP BY 1), m AS (SELECT stream_id, count(*) AS message_count FROM t_messages GROUP BY 1)
 SELECT s.segment_id, s.stream_id, message_count, cue_count FROM t_segments s JOIN m ON s.stream_id = m.stream_id JOIN t ON s.stream_id = t.video_id""")
def _(v):
    facts = segment.transcript_facts(windows.resolve_cue_ends(v("t_cues")))
    out = reports.programme_segments(stats.stream_counters(v("t_messages")), facts, v("t_segments"))
    return out.select("segment_id", "stream_id", "message_count", "cue_count")


@register("headline_fallback", """WITH k AS (SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS words FROM t_tokens WHERE pos < 4 GROUP BY 1)
 SELECT id, substr(CASE WHEN id % 3 = 0 AND trim(title) <> '' THEN trim(title) WHEN id % 3 = 1 AND trim(source) <> '' THEN trim(source) ELSE coalesce(words, '0:00:00') END, 1, 120) AS headline
 FROM t_documents LEFT JOIN k ON id = doc_id""")
def _(v):
    words = v("t_tokens").where("pos < 4").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "token")))["token"].alias("keywords"))
    d = v("t_documents").join(words, F.col("id") == F.col("doc_id"), "left")
    d = d.select("id", F.when(F.col("id") % 3 == 0, F.col("title")).alias("headline"), F.when(F.col("id") % 3 == 1, F.col("source")).alias("summary"), "keywords", F.lit("0:00:00").alias("timecode"))
    return reports.headline_fallback(d)


def _predictions(v):
    t = v("t_predictions").withColumn("label", F.explode(F.array(F.lit(0), F.lit(1))))
    model = F.when(F.col("y_a") == F.col("label"), F.col("confidence_a")).otherwise(1 - F.col("confidence_a"))
    rules = F.when(F.col("y_b") == F.col("label"), 0.7).otherwise(0.3)
    return t.select("id", F.col("y_true").alias("actual"), "label", F.least(F.greatest(model, F.lit(0.01)), F.lit(0.99)).alias("p_model"), rules.alias("p_rules"))


_GRID = """WITH r AS (SELECT id, y_true AS actual, k AS label, least(greatest(CASE WHEN y_a = k THEN confidence_a ELSE 1 - confidence_a END, 0.01), 0.99) AS p, CASE WHEN y_b = k THEN CAST(0.7 AS DOUBLE) ELSE 0.3 END AS q FROM t_predictions, (VALUES (0), (1)) x(k)),
 g AS (SELECT CAST(i AS DOUBLE) / 20 AS alpha, CAST(t AS DOUBLE) AS temperature FROM range(21) a(i), (VALUES (0.5), (0.75), (1.0), (1.5), (2.0)) b(t)),
 w AS (SELECT *, pow(p, 1 / temperature) AS e FROM r, g), z AS (SELECT *, sum(e) OVER (PARTITION BY id, alpha, temperature) AS s FROM w),
 o AS (SELECT alpha, temperature, id, actual, label, row_number() OVER (PARTITION BY id, alpha, temperature ORDER BY round(alpha * e / s + (1 - alpha) * q, 9) DESC, label) AS k FROM z),
 c AS (SELECT alpha, temperature, actual, label AS predicted, count(*) AS n FROM o WHERE k = 1 GROUP BY ALL),
 t AS (SELECT alpha, temperature, actual AS label, sum(n) AS support, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS tp FROM c GROUP BY ALL), u AS (SELECT alpha, temperature, predicted AS label, sum(n) AS guessed FROM c GROUP BY ALL),
 f AS (SELECT t.alpha, t.temperature, round(CAST(sum(tp) AS DOUBLE) / sum(support), 6) AS accuracy, round(avg(CAST(2 * tp AS DOUBLE) / (support + coalesce(guessed, 0))), 6) AS macro_f1 FROM t LEFT JOIN u ON t.alpha = u.alpha AND t.temperature = u.temperature AND t.label = u.label GROUP BY ALL) """


@register("blend_grid", _GRID + "SELECT * FROM f")
def _(v):
    return reports.blend_grid(_predictions(v), ALPHAS, TEMPERATURES)


@register("fit_blend_alpha", _GRID + "SELECT * FROM f ORDER BY macro_f1 DESC, alpha, temperature LIMIT 1")
def _(v):
    return reports.fit_blend_alpha(reports.blend_grid(_predictions(v), ALPHAS, TEMPERATURES))


@register("cross_domain_eval", """WITH u AS (SELECT d.source AS domain, 'a' AS model, y_true AS actual, y_a AS predicted FROM t_predictions p JOIN t_documents d ON p.id = d.id UNION ALL SELECT d.source, 'b', y_true, y_b FROM t_predictions p JOIN t_documents d ON p.id = d.id),
 t AS (SELECT domain, model, actual AS label, count(*) AS support, count(*) FILTER (actual = predicted) AS tp FROM u GROUP BY ALL), g AS (SELECT domain, model, predicted AS label, count(*) AS guessed FROM u GROUP BY ALL)
 SELECT t.domain, t.model, CAST(sum(support) AS BIGINT) AS rows, round(CAST(sum(tp) AS DOUBLE) / sum(support), 6) AS accuracy, round(avg(CAST(2 * tp AS DOUBLE) / (support + coalesce(guessed, 0))), 6) AS macro_f1
 FROM t LEFT JOIN g ON t.domain = g.domain AND t.model = g.model AND t.label = g.label GROUP BY ALL""")
def _(v):
    p = v("t_predictions").join(v("t_documents").select("id", F.col("source").alias("domain")), "id")
    one = lambda m: p.select("domain", F.lit(m).alias("model"), F.col("y_true").alias("actual"), F.col(f"y_{m}").alias("predicted"))
    return reports.cross_domain_eval(one("a").unionByName(one("b")))
