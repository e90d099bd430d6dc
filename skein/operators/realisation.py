"""Whether elements are realised: functionally by products, specifications and mappings, technically by services.

edges: id, type, source_id, target_id; mappings: id, target_id, coverage, percentage, gaps, capability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import gap_reason

# Edge types that carry each kind of realisation.
FUNCTIONAL, TECHNICAL = ["fulfils", "specifies"], ["implements", "realizedBy"]


def coverage(value: Column) -> Column:
    return F.when(value.isin("full", "partial"), value).otherwise("none")


def elements(nodes: DataFrame, edges: DataFrame, mappings: DataFrame) -> DataFrame:
    """nodes with fulfils, specifies, technical and incoming edge counts, any_full, any_mapped, functional, is_technical."""
    # ids repeat in stores, so edges count once per id
    counts = edges.groupBy(F.col("target_id").alias("id"), F.col("id").alias("_edge")).agg(F.first("type").alias("type"))
    counts = counts.groupBy("id").agg(F.count_if(F.col("type") == "fulfils").alias("fulfils"), F.count_if(F.col("type") == "specifies").alias("specifies"), F.count_if(F.col("type").isin(*TECHNICAL)).alias("technical"), F.count(F.lit(1)).alias("incoming"))
    mapped = mappings.groupBy(F.col("target_id").alias("id")).agg(F.bool_or(coverage(F.col("coverage")) == "full").alias("any_full"), F.bool_or(coverage(F.col("coverage")) != "none").alias("any_mapped"))
    joined = nodes.join(counts, "id", "left").join(mapped, "id", "left").fillna(0, ["fulfils", "specifies", "technical", "incoming"]).fillna(False, ["any_full", "any_mapped"])
    return joined.withColumns({"functional": (F.col("fulfils") > 0) | (F.col("specifies") > 0) | F.col("any_mapped"), "is_technical": F.col("technical") > 0})


def row_status() -> Column:
    return F.when(~F.col("functional"), "uncovered").when(F.col("any_full"), "covered").otherwise("partial")


def cell_status(coverages: Column) -> Column:
    """Worst wins; no claim is uncovered."""
    return F.when((F.size(coverages) == 0) | F.array_contains(coverages, "none"), "uncovered").when(F.array_contains(coverages, "partial"), "partial").otherwise("covered")


def cells(mappings: DataFrame, claims: DataFrame) -> DataFrame:
    """row, column, status, percentage, first_mapping, gaps of every cell that has a mapping.

    claims: column (a product), capability; a mapping belongs to the products that claim its capability.
    """
    joined = mappings.join(claims.distinct(), "capability")
    grouped = joined.groupBy(F.col("target_id").alias("row"), "column").agg(
        F.collect_set(coverage(F.col("coverage"))).alias("_c"), F.max("percentage").alias("percentage"), F.min("id").alias("first_mapping"), F.transform(F.array_sort(F.collect_list(F.struct("id", "gaps"))), lambda s: s["gaps"]).alias("_g")
    )
    return grouped.select("row", "column", cell_status(F.col("_c")).alias("status"), "percentage", "first_mapping", F.flatten("_g").alias("gaps"))


def matrix(rows: DataFrame, columns: DataFrame | list[str], mappings: DataFrame, claims: DataFrame) -> DataFrame:
    """``cells`` of every row (id) and column (id, or named), also of those that no mapping covers: these are uncovered."""
    if isinstance(columns, list):
        columns = rows.sparkSession.createDataFrame([(c,) for c in columns], "id string")
    wanted = columns.select(F.col("id").alias("column"))
    known = cells(mappings, claims.join(wanted, "column", "left_semi"))
    return rows.select(F.col("id").alias("row")).crossJoin(wanted).join(known, ["row", "column"], "left").withColumn("status", F.coalesce("status", F.lit("uncovered")))


def coverage_summary(rows: DataFrame) -> DataFrame:
    """covered, partial, uncovered, total and percentage of rows with a status; a partial one counts half."""
    sums = rows.agg(F.count_if(F.col("status") == "covered").alias("covered"), F.count_if(F.col("status") == "partial").alias("partial"), F.count_if(F.col("status") == "uncovered").alias("uncovered"), F.count(F.lit(1)).alias("total"))
    percent = F.floor((F.col("covered") + 0.5 * F.col("partial")) / F.col("total") * 100 + 0.5)
    return sums.withColumn("percentage", F.when(F.col("total") > 0, percent).otherwise(0).cast("long"))


def gaps(assessed: DataFrame, layer: str = "both") -> DataFrame:
    """id, name, missing, priority, reason of elements that lack a realisation, most incoming edges first."""
    missing = F.array_compact(F.array(F.when(~F.col("functional"), "L2"), F.when(~F.col("is_technical"), "L3")))
    chosen = {"both": F.lit(True), "functional": ~F.col("functional"), "technical": ~F.col("is_technical")}[layer]
    found = assessed.where((~F.col("functional") | ~F.col("is_technical")) & chosen)
    return found.select("id", "name", missing.alias("missing"), F.col("incoming").alias("priority"), gap_reason(F.col("functional"), F.col("is_technical")).alias("reason")).orderBy(F.col("priority").desc(), "id")


def gap_summary(assessed: DataFrame) -> DataFrame:
    return assessed.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("functional")).alias("functional_gaps"), F.count_if(~F.col("is_technical")).alias("technical_gaps"), F.count_if(F.col("functional") & F.col("is_technical")).alias("fully_realised"))
