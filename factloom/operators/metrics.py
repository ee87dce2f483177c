"""Entailment, classification and agreement metrics, all as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What metrics are rounded to where results are compared.
DIGITS = 9


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def proportion(prediction: Column, weight: Column | None = None) -> Column:
    """Weighted share of entailed items; 0 for none. Weights are whole numbers, and 0 is an error."""
    if weight is None:
        return F.coalesce(F.sum(prediction.cast("double")) / F.count(prediction), F.lit(0.0))
    w = weight.cast("bigint")
    w = F.when(w == 0, F.raise_error(F.lit("a weight is 0")).cast("bigint")).otherwise(w)
    return F.coalesce(F.try_divide(F.sum(prediction * w).cast("double"), F.sum(w).cast("double")), F.lit(0.0))


def counts(truth: Column, prediction: Column) -> dict[str, Column]:
    return {
        "tp": F.count_if((truth == 1) & (prediction == 1)),
        "fp": F.count_if((truth == 0) & (prediction == 1)),
        "fn": F.count_if((truth == 1) & (prediction == 0)),
        "tn": F.count_if((truth == 0) & (prediction == 0)),
    }


def classification_by_group(df: DataFrame, keys: list[str], truth: str, prediction: str, not_parseable: str) -> DataFrame:
    """n, share of unparseable answers, accuracy, precision, recall, F1, where an undefined metric is 0.

    Rows with a null key belong to no group.
    """
    sums = df.na.drop(subset=keys).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.col(not_parseable).cast("int")).alias("not_parseable"), *[c.alias(n) for n, c in counts(F.col(truth), F.col(prediction)).items()]
    )
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), DIGITS)
    return sums.select(
        *keys, "n", F.round("not_parseable", DIGITS).alias("not_parseable"),
        zero(_ratio(tp + tn, tp + fp + fn + tn)).alias("accuracy"), zero(_ratio(tp, tp + fp)).alias("precision"),
        zero(_ratio(tp, tp + fn)).alias("recall"), zero(_ratio(2 * tp, 2 * tp + fp + fn)).alias("f1_score"),
    )


def confusion(df: DataFrame, truth: str, prediction: str, keys: list[str] | None = None) -> DataFrame:
    """sensitivity, specificity, PPV, NPV, F1 and accuracy of class 1; undefined ones are null."""
    sums = df.groupBy(*(keys or [])).agg(*[c.alias(n) for n, c in counts(F.col(truth), F.col(prediction)).items()])
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    told = {"sensitivity": (tp, tp + fn), "specificity": (tn, tn + fp), "ppv": (tp, tp + fp), "npv": (tn, tn + fn), "f1": (2 * tp, 2 * tp + fp + fn), "accuracy": (tp + tn, tp + fp + fn + tn)}
    return sums.select(*(keys or []), "tp", "fp", "fn", "tn", *[F.round(_ratio(*x), DIGITS).alias(n) for n, x in told.items()])


def document_scores(judged: DataFrame, keys: list[str], kind: str = "entailment_type", prediction: str = "entailment_pred") -> DataFrame:
    """Fact precision, recall and F1 of each document, from one aggregation of both kinds of pairs.

    F1 is 0 if both are 0, and null, like the missing side, for a document that has one kind of pairs only. Null predictions
    (skipped answers) count nowhere.
    """
    x = F.col(prediction)
    p, r = (F.col(kind) == "precision") & x.isNotNull(), (F.col(kind) == "recall") & x.isNotNull()
    # Nulls are left out inside the aggregation: a filter would be pushed below, and evaluate the parser once more for it.
    sums = judged.groupBy(*keys).agg(
        F.count_if(p).alias("n_facts"), F.count_if(p & (x == 0)).alias("fact_fp"), F.sum(F.when(p, x)).alias("p1"),
        F.count_if(r).alias("n_sents"), F.count_if(r & (x == 0)).alias("fact_fn"), F.sum(F.when(r, x)).alias("r1"),
    )
    sums = sums.where("n_facts + n_sents > 0").select("*", _ratio(F.col("p1"), F.col("n_facts")).alias("p"), _ratio(F.col("r1"), F.col("n_sents")).alias("r"))
    f1 = F.when(F.col("p") + F.col("r") == 0, 0.0).otherwise(2 * F.col("p") * F.col("r") / F.when(F.col("p") + F.col("r") != 0, F.col("p") + F.col("r")))
    only = lambda n, c: F.when(F.col(n) > 0, F.col(c)).alias(c)
    return sums.select(
        *keys, F.round("p", DIGITS).alias("fact_precision"), only("n_facts", "fact_fp"), only("n_facts", "n_facts"),
        F.round("r", DIGITS).alias("fact_recall"), only("n_sents", "fact_fn"), only("n_sents", "n_sents"), F.round(f1, DIGITS).alias("fact_f1"),
    )


def rollup_stats(df: DataFrame, key: str, columns: dict[str, str], digits: int = 6) -> DataFrame:
    """Mean, sample variance, minimum and maximum of columns by one key; columns maps each to its short name."""
    told = [f(F.col(c)).alias(f"{short}_{n}") for c, short in columns.items() for n, f in (("mean", F.avg), ("var", F.var_samp), ("min", F.min), ("max", F.max))]
    out = df.groupBy(key).agg(*told)
    return out.select(key, *[F.round(F.col(c).cast("double"), digits).alias(c) for c in out.columns if c != key])


def weighted_means(df: DataFrame, keys: list[str], weight: str, columns: list[str]) -> DataFrame:
    w = F.col(weight)
    return df.groupBy(*keys).agg(*[F.round(_ratio(F.sum(w * F.col(c)), F.sum(w)), DIGITS).alias(c) for c in columns], F.sum(w).cast("bigint").alias(weight))


def macro_mean(df: DataFrame, inner: list[str], outer: list[str], value: str) -> DataFrame:
    """The unweighted mean, by the outer keys, of the means by the inner ones, with the number of rows."""
    each = df.groupBy(*inner).agg(F.avg(value).alias("m"), F.count("*").alias("n"))
    return each.groupBy(*outer).agg(F.round(F.avg("m"), DIGITS).alias("value"), F.sum("n").alias("n"))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins, the last closed: bin, from, to, n, share. Bounds come from one aggregation, counts from another."""
    x = F.col(column).cast("double")
    bounds = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("total")).alias("b")).scalar()
    known = df.where(x.isNotNull()).select(x.alias("x"), bounds.alias("b")).select("x", "b.lo", "b.hi", "b.total")
    spread = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    place = F.least(F.coalesce(F.floor((F.col("x") - F.col("lo")) * bins / spread), F.lit(0)), F.lit(bins - 1))
    counted = known.groupBy(place.cast("int").alias("bin"), "lo", "hi", "total").agg(F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    return counted.select(
        "bin", F.round(F.col("lo") + F.col("bin") * width, 6).alias("low"), F.round(F.col("lo") + (F.col("bin") + 1) * width, 6).alias("high"), "n", F.round(F.col("n") / F.col("total"), 6).alias("share")
    )


def shares(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by key and their share of all rows."""
    total = df.agg(F.count("*").alias("total")).scalar()
    return df.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, "n", F.round(F.col("n") / total, DIGITS).alias("share"))


def category_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """variable, level, n and percentage of each level of each column."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "variable", "level")
    counted = long.groupBy("variable", "level").agg(F.count("*").alias("n"))
    totals = long.groupBy("variable").agg(F.count("*").alias("total"))
    return counted.join(F.broadcast(totals), "variable").select("variable", "level", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("percent"))


def fleiss_kappa(ratings: DataFrame, unit: str, rater: str, label: str, raters: int) -> DataFrame:
    """Agreement of two or more raters on 0/1 labels over the units that all of them rated, in the long form."""
    per = ratings.where(F.col(label).isNotNull()).groupBy(unit).agg(F.countDistinct(rater).alias("m"), F.count_if(F.col(label) == 1).alias("k1"), F.count_if(F.col(label) == 0).alias("k0"))
    per = per.where(F.col("m") == raters)
    m = F.lit(float(raters))
    agreed = (F.col("k1") * (F.col("k1") - 1) + F.col("k0") * (F.col("k0") - 1)) / (m * (m - 1))
    sums = per.agg(F.count("*").alias("n_units"), F.avg(agreed).alias("p"), (F.sum("k1") / (F.count("*") * m)).alias("p1"), (F.sum("k0") / (F.count("*") * m)).alias("p0"))
    chance = F.col("p1") * F.col("p1") + F.col("p0") * F.col("p0")
    return sums.select("n_units", F.round(F.when(chance != 1, (F.col("p") - chance) / F.nullif(1 - chance, F.lit(0.0))), DIGITS).alias("kappa"))
