"""Registered model training over the labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from airwave.operators import models, windows
from airwave.plans.catalog import register
from airwave.sources.files import keep, scratch

#: folds, vocabulary and rounds of the registered fits
FOLDS, CAP, ROUNDS = 3, 2000, 20
NAMES = ["ordinary", "toxic"]


def _labelled(v, folds=FOLDS):
    """(id, text, label, fold) of every labelled document."""
    rows = v("t_predictions").select("id", (1 - F.col("y_b")).cast("double").alias("label")).where("label is not null")
    rows = windows.stratified_folds(rows, "label", folds)
    return rows.join(v("t_documents").select("id", F.col("content").alias("text")), "id").select("id", "text", "label", "fold")


def _vectors(v):
    docs = keep(_labelled(v), "labelled")
    totals = models.text_totals(docs.select("id", "text"), False)
    return docs, keep(models.most_frequent(totals, docs.count(), 2, CAP, ("word",)), "vocabulary")


def _features(v):
    docs, vocabulary = _vectors(v)
    return models.vectorize(docs, None, vocabulary, False)


_COUNTS = """WITH l AS (SELECT p.id, d.content FROM t_predictions p JOIN t_documents d ON d.id = p.id WHERE y_b IS NOT NULL), w AS (SELECT l.id, pos, token, lead(token) OVER (PARTITION BY l.id ORDER BY pos) AS nxt FROM l JOIN t_tokens t ON t.doc_id = l.id),
 c AS (SELECT id, term, count(*) AS tf FROM (SELECT id, token AS term FROM w UNION ALL SELECT id, token || '_' || nxt FROM w WHERE nxt IS NOT NULL) GROUP BY ALL), n AS (SELECT count(*) AS n FROM l),
 f AS (SELECT term, count(*) AS df, sum(tf) AS s FROM c GROUP BY 1 HAVING count(*) >= 2 ORDER BY s DESC, term LIMIT 2000), y AS (SELECT 'word' AS view, term, df, round(ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1, 9) AS idf, CAST(row_number() OVER (ORDER BY term) - 1 AS INT) AS index FROM f, n) """


@register("fit_vectorizer", """WITH l AS (SELECT p.id, d.content FROM t_predictions p JOIN t_documents d ON d.id = p.id WHERE y_b IS NOT NULL), w AS (SELECT l.id, token, lead(token) OVER (PARTITION BY l.id ORDER BY pos) AS nxt FROM l JOIN t_tokens t ON t.doc_id = l.id),
 g AS (SELECT id, p, unnest([2, 3, 4]) AS n FROM (SELECT id, ' ' || token || ' ' AS p FROM w)), e AS (SELECT 'word' AS view, id, token AS term FROM w UNION ALL SELECT 'word', id, token || '_' || nxt FROM w WHERE nxt IS NOT NULL
 UNION ALL SELECT 'char', id, substr(p, i, n) FROM (SELECT id, p, n, unnest(range(1, greatest(length(p) - n + 2, 1))) AS i FROM g)),
 c AS (SELECT view, id, term, count(*) AS tf FROM e GROUP BY ALL), n AS (SELECT count(*) AS n FROM l), f AS (SELECT view, term, count(*) AS df, sum(tf) AS s FROM c GROUP BY 1, 2 HAVING count(*) >= CASE view WHEN 'char' THEN 3 ELSE 2 END),
 k AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY s DESC, term) AS r FROM f)
 SELECT view, term, df, round(ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1, 9) AS idf, CAST(row_number() OVER (ORDER BY view, term) - 1 AS INT) AS index FROM k, n WHERE r <= 60000""")
def _(v):
    docs = keep(_labelled(v), "labelled")
    return models.fit_texts(docs.select("id", "text"), docs.count())


@register("vectorize", _COUNTS + ", x AS (SELECT c.id, y.index, y.term, (1 + ln(CAST(tf AS DOUBLE))) * idf AS w FROM c JOIN y ON y.term = c.term) SELECT id, index, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM x")
def _(v):
    docs, vocabulary = _vectors(v)
    return models.weights(models.term_counts(docs.select("id", "text"), False), vocabulary).select("id", "index", "term", F.round("weight", 6).alias("weight"))


@register("train_classifier")
def _(v):
    rows = _features(v)
    model = models.train_classifier(rows.where("fold <> 0"), rounds=ROUNDS)
    return models.scores(rows, model).select("id", "fold", "label", "prediction", F.round(F.get("p", F.lit(1)), 6).alias("p_toxic"))


@register("predict")
def _(v):
    rows = _features(v)
    return models.predict(rows, models.train_classifier(rows, "svm", rounds=5), NAMES, "ordinary").select("id", "label", F.round("confidence", 6).alias("confidence"))


@register("save_model")
def _(v):
    """What is predicted before a model is stored and after it is read again."""
    rows = _features(v)
    spark, model = rows.sparkSession, models.train_classifier(rows, rounds=ROUNDS)
    path = scratch(spark, "model")
    models.save_model(spark, model, path, NAMES, {"rows": float(rows.count())})
    again, labels, note = models.load_model(spark, path)
    p = lambda m, name: models.scores(rows, m).select("id", F.round(F.get("p", F.lit(1)), 6).alias(name))
    return p(model, "before").join(p(again, "after"), "id").withColumn("labels", F.lit("+".join(labels))).withColumn("note", F.lit(note).cast("string"))


@register("load_model")
def _(v):
    """Notes on models that cannot be used, beside one that can."""
    rows = _features(v)
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "model")
    models.save_model(spark, models.train_classifier(rows, rounds=3), path, NAMES, {})
    other = scratch(spark, "model")
    spark.createDataFrame([(models.VERSION + 1, "x.Y", NAMES)], "version int, kind string, labels array<string>").write.json(f"{other}/about")
    out = [(name, m is not None, note[:30] if note else None) for name, (m, _, note) in (("stored", models.load_model(spark, path)), ("newer", models.load_model(spark, other)), ("missing", models.load_model(spark, path + "-none")))]
    return spark.createDataFrame(out, "model string, usable boolean, note string").withColumn("rows", F.lit(rows.count()))


@register("cross_validate")
def _(v):
    """Each fold, and the mean and deviation over them; as many folds as the smallest class can fill."""
    rows = _features(v)
    folds = windows.fold_count(rows, "label", FOLDS)
    found = models.cross_validate(keep(models.out_of_fold(rows, folds, rounds=ROUNDS), "folds"), folds)
    m = models.spread(found)
    return rows.sparkSession.createDataFrame([(*f, m["macro_f1_mean"], m["macro_f1_deviation"]) for f in found], "fold int, accuracy double, macro_f1 double, mean double, deviation double")


@register("grid_search")
def _(v):
    """The reference's grids and five folds over both views, every fit until it converges."""
    docs = keep(_labelled(v, 5), "labelled")
    vocabulary = keep(models.fit_texts(docs.select("id", "text"), docs.count()), "vocabulary")
    rows = models.vectorize(docs, None, vocabulary)
    found = models.grid_search(rows, 5)
    return rows.sparkSession.createDataFrame(found, "algo string, C double, macro_f1 double")


@register("stacking")
def _(v):
    rows = _features(v)
    one, two = (keep(models.out_of_fold(rows, FOLDS, a, rounds=ROUNDS), "folds") for a in ("logistic", "bayes"))
    return models.stacking(one, two, FOLDS, ROUNDS).select("id", "fold", "label", "prediction", F.round(F.get("p", F.lit(1)), 6).alias("p_toxic"))


@register("ablate")
def _(v):
    docs = keep(_labelled(v), "labelled")
    found = models.ablate(docs, {"both views": {}, "words": {"char": False}, "frequent words": {"char": False, "min_df": 20}}, FOLDS, 10)
    return docs.sparkSession.createDataFrame(found, "setting string, features long, accuracy double, macro_f1 double")


@register("calibrate")
def _(v):
    """Probabilities of calibrated support vectors, before they are stored and after they are read again."""
    rows = _features(v)
    spark, model, path = rows.sparkSession, models.train_classifier(rows, "svm", rounds=5), scratch(rows.sparkSession, "model")
    models.save_model(spark, model, path, NAMES, {})
    again, _, _ = models.load_model(spark, path)
    p = lambda m, name: models.scores(rows, m).select("id", "label", F.round(F.get("p", F.lit(1)), 6).alias(name))
    return p(model, "p_toxic").join(p(again, "p_again").drop("label"), "id")


@register("out_of_fold_alpha")
def _(v):
    """A model blended with a rule that calls long texts toxic."""
    rows = _features(v)
    rule = F.when(F.length("text") > 1500, 0.6).otherwise(0.2)
    rules = rows.select("id", F.array(1 - rule, rule).alias("p"))
    return models.out_of_fold_alpha(rows, rules, FOLDS, [0.0, 0.25, 0.5, 0.75, 1.0], [0.5, 1.0], rounds=ROUNDS)
