"""Scores of predictions against labels: precision, recall, F1, bands and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise_name

BAND = 0.8


def _f1(p, r):
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def precision_recall(predicted: DataFrame, gold: DataFrame, keys: list[str], by: str) -> DataFrame:
    """kind (null: overall), tp, fp, fn, precision, recall, f1; per kind only for kinds that labels have.

    Distinct keys, one full outer join, and both levels in one pass over it.
    """
    p = predicted.select(*keys).distinct().withColumn("_p", F.lit(1))
    g = gold.select(*keys).distinct().withColumn("_g", F.lit(1))
    both = p.join(g, keys, "full").select(F.col(by).alias("kind"), F.coalesce("_p", F.lit(0)).alias("_p"), F.coalesce("_g", F.lit(0)).alias("_g"))
    sums = both.rollup("kind").agg(F.grouping("kind").alias("_all"), F.sum(F.col("_p") * F.col("_g")).alias("tp"), F.sum(F.col("_p") * (1 - F.col("_g"))).alias("fp"), F.sum((1 - F.col("_p")) * F.col("_g")).alias("fn"))
    known = sums.where("_all = 1 or tp + fn > 0")
    pr, re = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0)), F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(F.lit(0.0))
    return known.select("kind", "tp", "fp", "fn", pr.alias("precision"), re.alias("recall"), _f1(pr, re).alias("f1"))


def band_precision(judged: DataFrame, least: float = BAND) -> DataFrame:
    """Precision among predictions with enough confidence; judged: confidence, correct (boolean)."""
    return judged.where(F.col("confidence") >= least).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("band_precision"))


def calibration(judged: DataFrame) -> DataFrame:
    """One less the mean distance between confidence and outcome."""
    return judged.agg(F.count(F.lit(1)).alias("n"), (1 - F.avg(F.abs(F.col("confidence") - F.col("correct").cast("double")))).alias("calibration"))


def coverage_scores(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """covered precision and recall, band precision and exact accuracy of claims; the first prediction of a capability counts.

    predicted: capability, coverage, confidence, ord; gold: capability, coverage.
    """
    first = predicted.groupBy("capability").agg(F.min_by(F.struct("coverage", "confidence"), "ord").alias("_p"))
    both = gold.join(first, "capability", "left").select("coverage", F.col("_p.coverage").alias("said"), F.col("_p.confidence").alias("confidence"))
    covered = lambda c: F.coalesce(F.col(c) == "full", F.lit(False))
    tp = F.count_if(covered("coverage") & covered("said"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return both.agg(
        ratio(tp, F.count_if(covered("said"))).alias("covered_precision"),
        ratio(tp, F.count_if(covered("coverage"))).alias("covered_recall"),
        ratio(F.count_if(covered("coverage") & covered("said") & (F.col("confidence") >= BAND)), F.count_if(covered("said") & (F.col("confidence") >= BAND))).alias("band_precision"),
        ratio(F.count_if(F.col("coverage") == F.col("said")), F.count(F.lit(1))).alias("accuracy"),
    )


def named_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """type, source, target: relations (type, source_id, target_id) by the normalised names of their ends; unknown ends drop them."""
    names = entities.select("id", normalise_name(F.col("name")).alias("_n"))
    out = relations.where("type is not null")
    for end in ("source", "target"):
        out = out.join(names.select(F.col("id").alias(f"{end}_id"), F.col("_n").alias(end)), f"{end}_id")
    return out.select("type", "source", "target").distinct()


def relation_scores(relations: DataFrame, entities: DataFrame, gold: DataFrame) -> DataFrame:
    """``precision_recall`` of relations by names; gold: type, source, target as stated."""
    wanted = gold.select("type", normalise_name(F.col("source")).alias("source"), normalise_name(F.col("target")).alias("target"))
    return precision_recall(named_relations(relations, entities), wanted, ["type", "source", "target"], "type")
