"""Phrase matching, name repair, reaction samples, and grids over predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from airwave.operators import joins


def phrase_matches(tokens: DataFrame, phrases: DataFrame, longest: int = 3) -> DataFrame:
    """(doc_id, pos, term, words): at each position the longest phrase (1 to ``longest`` words, joined by one
    blank) that begins there. A small phrase table is broadcast by the optimizer, a large one is shuffled."""
    w = W.partitionBy("doc_id").orderBy("pos")
    grams, gram = [], F.col("token")
    for n in range(1, longest + 1):
        gram = F.concat(gram, F.lit(" "), F.lead("token", n - 1).over(w)) if n > 1 else gram
        grams.append(F.struct(F.lit(n).alias("words"), gram.alias("term")))
    rows = tokens.select("doc_id", "pos", F.array(*grams).alias("gs")).select("doc_id", "pos", F.explode("gs").alias("g")).select("doc_id", "pos", "g.words", "g.term").where("term is not null")
    found = rows.join(phrases.select("term").distinct(), "term")
    return found.groupBy("doc_id", "pos").agg(F.max_by("term", "words").alias("term"), F.max("words").alias("words"))


def _prefixes(names: DataFrame, least: int) -> DataFrame:
    """(name, prefix) of every proper prefix of at least ``least`` characters."""
    long = names.where(F.length("name") > least)
    return long.select("name", F.explode(F.sequence(F.lit(least), F.length("name") - 1)).alias("_k")).select("name", F.substring("name", F.lit(1), F.col("_k")).alias("prefix"))


def collapse_variants(names: DataFrame, least: int = 2, bodies: int = 3) -> DataFrame:
    """(name, body): the longest proper prefix that stands alone as a name and begins at least ``bodies`` names."""
    pairs = _prefixes(names.select("name").distinct(), least)
    alone = pairs.join(names.select(F.col("name").alias("prefix")).distinct(), "prefix", "left_semi")
    common = alone.groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") >= bodies)
    return alone.join(common, "prefix").groupBy("name").agg(F.max_by("prefix", F.length("prefix")).alias("body"))


def correct_names(lexicon: DataFrame, droppable: DataFrame, least: int = 4, support: int = 3, wanted: DataFrame | None = None) -> DataFrame:
    """(name, corrected): for names of ``lexicon`` (name, support) without support, or of ``wanted`` alone, the longest
    supported prefix of at least ``least`` characters whose remainder is a word that may be dropped."""
    weak = (lexicon if wanted is None else wanted).where((F.col("support") < support) & (F.length("name") > least))
    pairs = _prefixes(weak, least).withColumn("rest", F.expr("substring(name, length(prefix) + 1)"))
    strong = lexicon.where(F.col("support") >= support).select(F.col("name").alias("prefix"))
    fit = pairs.join(strong, "prefix", "left_semi").join(droppable.select(F.col("term").alias("rest")), "rest", "left_semi")
    return fit.groupBy("name").agg(F.max_by("prefix", F.length("prefix")).alias("corrected"))


def reaction_samples(messages: DataFrame, segments: DataFrame, k: int = 12) -> DataFrame:
    """(segment_id, message_id, nth): ``k`` messages on air from a quarter of the way on, in order of time.
    A message's place comes from day-wise counts, so a segment of any size needs no task of its own."""
    rows = joins.segment_messages(messages, segments).select("segment_id", "message_id", "offset_ms", F.floor(F.col("offset_ms") / joins.DAY).alias("_day"))
    days = rows.groupBy("segment_id", "_day").agg(F.count("*").alias("n"))
    before = W.partitionBy("segment_id").orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    days = days.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("_total", F.sum("n").over(W.partitionBy("segment_id"))).drop("n")
    near = rows.join(days, ["segment_id", "_day"])
    nth = F.col("_before") + F.row_number().over(W.partitionBy("segment_id", "_day").orderBy("offset_ms", "message_id"))
    quarter = F.floor(F.col("_total") / 4)
    return near.withColumn("nth", nth - quarter).where(F.col("nth").between(1, k)).select("segment_id", "message_id", "nth")


def programme_segments(streams: DataFrame, transcripts: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments of programmes that have both a chat stream and a transcript."""
    t = transcripts.withColumnRenamed("video_id", "stream_id")
    return segments.join(streams, "stream_id").join(t, "stream_id")


def headline_fallback(rows: DataFrame, cap: int = 120) -> DataFrame:
    """``rows`` (id, headline, summary, keywords, timecode) with the first of them that says something."""
    said = lambda c: F.nullif(F.trim(c), F.lit(""))
    words = F.array_join(F.slice(F.coalesce("keywords", F.array().cast("array<string>")), 1, 4), " ")
    line = F.coalesce(said(F.col("headline")), said(F.col("summary")), said(words), F.col("timecode"))
    return rows.select("id", F.substring(line, 1, cap).alias("headline"))


def blend_grid(rows: DataFrame, alphas: list[float], temperatures: list[float]) -> DataFrame:
    """(alpha, temperature, accuracy, macro_f1) of every grid point in one job. ``rows``: id, actual, label,
    p_model, p_rules. The grid is a constant that each row is unfolded over; predictions are reduced to
    confusion counts before anything else is shuffled."""
    grid = F.array(*(F.struct(F.lit(a).alias("alpha"), F.lit(t).alias("temperature")) for a in alphas for t in temperatures))
    per = rows.groupBy("id").agg(F.first("actual").alias("actual"), F.collect_list(F.struct("label", "p_model", "p_rules")).alias("ps"))
    per = per.withColumn("g", F.explode(grid))
    p = F.expr("transform(ps, x -> struct(round(g.alpha * pow(x.p_model, 1 / g.temperature) / aggregate(ps, 0D, (s, y) -> s + pow(y.p_model, 1 / g.temperature)) + (1 - g.alpha) * x.p_rules, 9) AS p, -x.label AS label))")
    guess = per.select("g.alpha", "g.temperature", "actual", (-F.array_max(p)["label"]).alias("predicted"))
    c = guess.groupBy("alpha", "temperature", "actual", "predicted").agg(F.count("*").alias("n"))
    by = ["alpha", "temperature"]
    right = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    truth = c.groupBy(*by, F.col("actual").alias("label")).agg(F.sum("n").alias("support"), right.alias("tp"))
    told = c.groupBy(*by, F.col("predicted").alias("label")).agg(F.sum("n").alias("guessed"))
    f1 = 2 * F.col("tp") / (F.col("support") + F.coalesce("guessed", F.lit(0)))
    scored = truth.join(told, [*by, "label"], "left").withColumn("f1", f1)
    return scored.groupBy(*by).agg(F.round(F.sum("tp") / F.sum("support"), 6).alias("accuracy"), F.round(F.avg("f1"), 6).alias("macro_f1"))


def fit_blend_alpha(grid: DataFrame) -> DataFrame:
    """The grid point with the best macro-F1; ties to the smaller alpha, then the smaller temperature."""
    return grid.orderBy(F.desc("macro_f1"), "alpha", "temperature").limit(1)


def cross_domain_eval(predictions: DataFrame) -> DataFrame:
    """(domain, model, rows, accuracy, macro_f1) over rows (domain, model, actual, predicted)."""
    by = ["domain", "model"]
    c = predictions.groupBy(*by, "actual", "predicted").agg(F.count("*").alias("n"))
    right = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    truth = c.groupBy(*by, F.col("actual").alias("label")).agg(F.sum("n").alias("support"), right.alias("tp"))
    told = c.groupBy(*by, F.col("predicted").alias("label")).agg(F.sum("n").alias("guessed"))
    scored = truth.join(told, [*by, "label"], "left").withColumn("f1", 2 * F.col("tp") / (F.col("support") + F.coalesce("guessed", F.lit(0))))
    return scored.groupBy(*by).agg(F.sum("support").alias("rows"), F.round(F.sum("tp") / F.sum("support"), 6).alias("accuracy"), F.round(F.avg("f1"), 6).alias("macro_f1"))


def reaction_detail(messages: DataFrame, segments: DataFrame, words: int = 8, samples: int = 12, **rules) -> DataFrame:
    """(segment_id, total, positive, neutral, negative, mood, words, samples) of every segment: the mix, its most
    frequent words (by ``rules`` of ``joins.reaction_words``) and the messages from a quarter of the way on."""
    mix = joins.reaction_overview(messages, segments)
    ordered = lambda rows, rank, value, name: rows.groupBy("segment_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(rank, value))), lambda x: x[value]).alias(name))
    top = ordered(joins.reaction_words(messages, segments, words, **rules), "rank", "word", "words")
    some = ordered(reaction_samples(messages, segments, samples), "nth", "message_id", "samples")
    none = F.array().cast("array<string>")
    return mix.join(top, "segment_id", "left").join(some, "segment_id", "left").withColumns({c: F.coalesce(c, none) for c in ("words", "samples")})
