"""Evaluation of predictions as aggregates over confusion counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_matrix(rows: DataFrame, truth: str, guess: str, labels: list[int]) -> DataFrame:
    """Dense counts (actual, predicted, n) over ``labels``."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], "actual int, predicted int")
    counts = rows.groupBy(F.col(truth).alias("actual"), F.col(guess).alias("predicted")).agg(F.count("*").alias("n"))
    return F.broadcast(grid).join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def classification_metrics(confusion: DataFrame) -> DataFrame:
    """Per label precision, recall, f1 and support, then accuracy (as recall), macro and weighted means; a zero
    denominator gives 0."""
    right = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    a = confusion.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("support"), right.alias("tp"))
    p = confusion.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("guessed"))
    div = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    out = a.join(p, "label").withColumn("precision", div(F.col("tp"), F.col("guessed"))).withColumn("recall", div(F.col("tp"), F.col("support")))
    out = out.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    names = ("precision", "recall", "f1")
    total = F.sum("support")
    sums = out.agg(total.alias("support"), (F.sum("tp") / total).alias("accuracy"), *(F.avg(c).alias(f"m_{c}") for c in names), *((F.sum(F.col(c) * F.col("support")) / total).alias(f"w_{c}") for c in names))
    none = F.lit(None).cast("double")
    row = lambda label, x: F.struct(F.lit(label).alias("label"), "support", *(F.round(v, 6).alias(c) for c, v in zip(names, x)))
    means = F.array(row("accuracy", (none, F.col("accuracy"), none)), row("macro", [F.col(f"m_{c}") for c in names]), row("weighted", [F.col(f"w_{c}") for c in names]))
    each = out.select(F.col("label").cast("string").alias("label"), "support", *(F.round(c, 6).alias(c) for c in names))
    return each.unionByName(sums.select(F.explode(means).alias("x")).select("x.*"))


def leaderboard(predictions: DataFrame, classes: int, active: str | None = None) -> DataFrame:
    """Accuracy and macro-F1 of each model over rows (model, actual, predicted), with the accuracy of guessing among
    ``classes``, the gain over it, and which model serves."""
    c = predictions.groupBy("model", "actual", "predicted").agg(F.count("*").alias("n"))
    a = c.groupBy("model", F.col("actual").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    p = c.groupBy("model", F.col("predicted").alias("label")).agg(F.sum("n").alias("guessed"))
    j = a.join(p, ["model", "label"], "left").withColumn("f1", 2 * F.col("tp") / (F.col("support") + F.coalesce("guessed", F.lit(0))))
    out = j.groupBy("model").agg((F.sum("tp") / F.sum("support")).alias("acc"), F.avg("f1").alias("f"), F.sum("support").alias("rows"))
    return out.select("model", F.round("acc", 6).alias("accuracy"), F.round("f", 6).alias("macro_f1"), "rows", F.lit(1 / classes).alias("baseline"), F.round(F.col("acc") - 1 / classes, 6).alias("gain"), (F.col("model") == F.lit(active)).alias("active"))


def complementarity(rows: DataFrame) -> DataFrame:
    a, b = F.col("y_a") == F.col("y_true"), F.col("y_b") == F.col("y_true")
    return rows.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("neither"), F.round(F.count_if(a | b) / F.count("*"), 6).alias("ceiling"))


def erfc(z):
    """Complementary error function of z >= 0 by a published polynomial (error below 2e-7)."""
    u = 1 / (1 + 0.3275911 * z)
    #: fixed values
    terms = ((0.254829592, 1), (-0.284496736, 2), (1.421413741, 3), (-1.453152027, 4), (1.061405429, 5))
    return F.exp(-z * z) * sum((a * F.pow(u, F.lit(n)) for a, n in terms[1:]), terms[0][0] * u)


def exact_tail(b: Column, c: Column) -> Column:
    """Two-sided p of b against c discordant pairs under even odds, from binomial coefficients one after the other; they
    are whole numbers that a double holds exactly up to some fifty pairs."""
    n, m = (b + c).cast("double"), F.least(b, c)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    steps = F.when(m > 0, F.sequence(F.lit(1).cast("bigint"), m.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * (n - i + 1) / i
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    return F.least(F.lit(1.0), 2 * F.aggregate(steps, start, step, lambda acc: acc["sum"]) / F.pow(F.lit(2.0), n))


def mcnemar(rows: DataFrame, by: str | None = None, few: int = 25) -> DataFrame:
    """Discordant pairs, the corrected chi-square statistic and the p-value, per ``by`` if given: exact below ``few``
    pairs, of the chi-square distribution (one degree of freedom) from there on."""
    right = lambda y: F.col(y) == F.col("y_true")
    only = lambda x, y: F.count_if(right(x) & ~right(y))
    c = rows.groupBy(*([by] if by else [])).agg(only("y_a", "y_b").alias("only_a"), only("y_b", "y_a").alias("only_b"))
    n = F.col("only_a") + F.col("only_b")
    x = F.when(n > 0, F.pow(F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0)), F.lit(2)) / n).otherwise(0.0)
    p = F.when(n < few, exact_tail(F.least("only_a", F.lit(few)), F.least("only_b", F.lit(few)))).otherwise(erfc(F.sqrt(F.col("_x") / 2)))
    return c.withColumn("_x", x).select(*([by] if by else []), "only_a", "only_b", F.round("_x", 6).alias("statistic"), F.round(p, 6).alias("p_value"))


def confidence_bands(rows: DataFrame, edges: tuple[float, ...] = (0.4, 0.6, 0.8)) -> DataFrame:
    """Rows, share and accuracy of each band, and the coverage and accuracy of answering only from the band upwards."""
    from pyspark.sql import Window as W

    band = F.lit(len(edges))
    for i, e in reversed([*enumerate(edges)]):
        band = F.when(F.col("confidence_a") < e, i).otherwise(band)
    per = rows.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.count_if(F.col("y_a") == F.col("y_true")).alias("k"))
    up = W.orderBy(F.desc("band"))  # over one row a band
    total = F.sum("n").over(W.partitionBy())
    return per.select(
        "band", "n", F.round(F.col("k") / F.col("n"), 6).alias("accuracy"), F.round(F.col("n") / total, 6).alias("share"),
        F.round(F.sum("n").over(up) / total, 6).alias("coverage"), F.round(F.sum("k").over(up) / F.sum("n").over(up), 6).alias("kept_accuracy"),
    )


def blend(rows: DataFrame, alpha: float) -> DataFrame:
    """Rows (id, label, p_model, p_rules): alpha * model + (1 - alpha) * rules, renormalised; the best label, ties to the smaller."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie in [0, 1]")
    p = alpha * F.coalesce("p_model", F.lit(0.0)) + (1 - alpha) * F.coalesce("p_rules", F.lit(0.0))
    best = rows.withColumn("p", F.round(p, 9)).groupBy("id").agg(F.sum("p").alias("s"), F.max(F.struct("p", -F.col("label"))).alias("b"))
    return best.select("id", (-F.col("b.col2")).alias("label"), F.round(F.col("b.p") / F.col("s"), 6).alias("confidence"))


def label_distribution(rows: DataFrame) -> DataFrame:
    """Actual and predicted counts per label, how many labels are predicted at all, and whether the model has
    collapsed to a third of the classes or fewer."""
    t = rows.groupBy(F.col("y_true").alias("label")).agg(F.count("*").alias("actual"))
    p = rows.groupBy(F.col("y_a").alias("label")).agg(F.count("*").alias("predicted"))
    out = t.join(p, "label", "full").select("label", F.coalesce("actual", F.lit(0)).alias("actual"), F.coalesce("predicted", F.lit(0)).alias("predicted"))
    sums = out.agg(F.count_if(F.col("predicted") > 0).alias("distinct_predicted"), F.count_if(F.col("actual") > 0).alias("_classes"))
    sums = sums.select("distinct_predicted", (F.col("distinct_predicted") <= F.greatest(F.lit(1), F.floor(F.col("_classes") / 3))).alias("collapsed"))
    return out.crossJoin(F.broadcast(sums))
