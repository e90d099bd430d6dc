"""From JSONL entries to nodes and edges of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RELATIONSHIP = "Relationship"


def _text(field: str) -> Column:
    return F.try_variant_get("data", f"$.{field}", "string")


def _evidence() -> Column:
    """The evidence that an entry's source stands for."""
    source = F.col("source")
    return F.array(F.struct(source["file"].alias("source"), source["location"].alias("location"), source["fetchedAt"].alias("fetchedAt"), source["sourceAuthority"].alias("sourceAuthority")))


def _given(field: str) -> Column:
    """Evidence as an entry's data state it; null without any."""
    kind = "array<struct<source:string,location:string,fetchedAt:string,sourceAuthority:string>>"
    return F.try_variant_get("data", f"$.{field}", kind)


def entry_nodes(entries: DataFrame) -> DataFrame:
    """id, type, version, lifecycle_status, valid_from, valid_to, evidence, confidence, name, data of entries that are no relationships.

    The fixed columns of an entry count, whatever its data say; states and times come from the data, else from defaults.
    """
    rows = entries.where(~F.col("type").eqNullSafe(F.lit(RELATIONSHIP)))
    return rows.select(
        "id", "type", "version",
        F.coalesce(_text("lifecycle_status"), F.lit("active")).alias("lifecycle_status"),
        F.coalesce(_text("validFrom"), "extractedAt").alias("valid_from"),
        _text("validTo").alias("valid_to"),
        F.coalesce(_given("evidencedBy"), _evidence()).alias("evidence"),
        "confidence", _text("name").alias("name"), "data",
    )


def entry_edges(entries: DataFrame) -> DataFrame:
    """id, version, type, source_id, target_id, confidence, evidence, metadata, problem of relationship entries.

    The problem names what cannot be mapped, a blank or missing type or end; such rows fail for good.
    """
    rows = entries.where(F.col("type") == RELATIONSHIP)
    keys = {"type": "relationshipType", "source_id": "sourceEntityId", "target_id": "targetEntityId"}
    lacking = F.array_compact(F.array(*[F.when(F.coalesce(_text(f), F.lit("")) == "", F.lit(f)) for f in keys.values()]))
    problem = F.when(F.size(lacking) > 0, F.concat(F.lit("missing "), F.array_join(lacking, "/")))
    return rows.select("id", "version", *[_text(f).alias(c) for c, f in keys.items()], "confidence", _evidence().alias("evidence"), F.try_variant_get("data", "$.metadata", "variant").alias("metadata"), problem.alias("problem"))


# The fields that an extracted row carries about itself, which are no data of the entity.
META_FIELDS = ["type", "confidence", "model_confidence", "evidence", "source", "location"]


def entity_data(row: Column, meta: list[str] = META_FIELDS) -> Column:
    """An extracted row (a map from field to text) without the fields about itself and without nulls."""
    return F.map_filter(row, lambda k, v: ~k.isin(*meta) & v.isNotNull())
