"""Annotation samples, shares of work, and label merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.names import unused
from factloom.operators.numbering import number_rows
from factloom.operators.relational import majority, natural_left_join, union_all
from factloom.operators.sampling import global_sample


def assign(rows: DataFrame, restricted: str, key: str, no_access: list[str], access: list[str]) -> DataFrame:
    """Deal rows to annotators in blocks of ceil(n/k): unrestricted rows first, to those without access; within a class
    in turn. Fails if a restricted row would go to an annotator without access."""
    n, k = rows.count(), len(no_access) + len(access)
    block = -(-n // k) if n else 0
    first = len(no_access) * block
    late, rn = unused([*rows.columns, "annotator"], "late", "rn")
    numbered = number_rows(rows.withColumn(late, F.coalesce(F.col(restricted), F.lit(False)).cast("int")), [late, key], rn)
    pick = lambda names, place: F.get(F.array(*map(F.lit, names)), place.cast("int")) if names else F.lit(None).cast("string")
    low, high = (F.col(rn) - 1) % max(1, len(no_access)), (F.col(rn) - 1 - first) % max(1, len(access))
    to = F.when(F.col(rn) <= first, pick(no_access, low)).otherwise(pick(access, high))
    guarded = F.when((F.col(rn) <= first) & (F.col(late) == 1), F.raise_error(F.lit("too few unrestricted rows")).cast("string")).otherwise(to)
    return numbered.withColumn("annotator", guarded).drop(late, rn)


def annotation_sample(pairs: DataFrame, models: list[str], n: int = 1200, seed: int = 42, key: str = "uid") -> DataFrame:
    return global_sample(pairs.where(F.col("model_name").isin(models)), n, seed=seed, key=key)


def with_shared_rows(rows: DataFrame, n_shared: int, annotators: list[str], restricted: str, key: str, no_access: list[str], seed: int = 42) -> DataFrame:
    """n_shared rows go to every annotator; the rest is dealt out."""
    common = global_sample(rows, n_shared, seed=seed, key=key)
    everyone = common.withColumn("annotator", F.explode(F.array(*map(F.lit, annotators))))
    rest = rows.join(common.select(key), key, "left_anti")
    return union_all(everyone, assign(rest, restricted, key, no_access, [a for a in annotators if a not in no_access]))


def human_labels(shared_ratings: DataFrame, single_ratings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Majority labels of shared rows and the single labels of the others, with the model's verdicts; a missing rating is 0.

    Ratings: unique_id, ord, inferrable. Rows without a verdict are dropped.
    """
    filled = shared_ratings.withColumn("human_label", F.coalesce(F.col("inferrable").cast("int"), F.lit(0)))
    labels = union_all(majority(filled, "unique_id", "human_label", "ord"), single_ratings.select("unique_id", F.coalesce(F.col("inferrable").cast("int"), F.lit(0)).alias("human_label")))
    return natural_left_join(labels, verdicts).where(F.col("entailment_pred").isNotNull())
