"""Schema files, golden datasets and output folders: the small, driver-side parts of a run."""

from __future__ import annotations

import json
import os
import shutil
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonschema
from ..operators.gates import schema_check


class Schemas:
    """JSON schemas found below a folder, by the type they fix; their layer is the folder they are in."""

    def __init__(self, root: str) -> None:
        self._known: dict[str, dict] = {}
        self._layers: dict[str, str] = {}
        seen: set[str] = set()
        for path in sorted(Path(root).rglob("*.schema.json")):
            schema = json.loads(path.read_text())
            if (name := schema.get("$id")) in seen:
                raise ValueError(f"two schemas have the id {name}")
            if name is not None:
                seen.add(name)
            kind = schema.get("properties", {}).get("type", {}).get("const")
            if kind:
                self._known[kind] = schema
                self._layers[kind] = path.parent.name

    def types(self) -> list[str]:
        return sorted(self._known)

    def get(self, kind: str) -> dict:
        return self._known[kind]

    def layer(self, kind: str) -> str | None:
        return self._layers.get(kind)

    def required(self, kind: str) -> list[str]:
        """Required fields of a schema and all it is composed of; references to other files are not followed."""
        out: dict[str, None] = {}

        def collect(s: dict) -> None:
            out.update(dict.fromkeys(s.get("required", [])))
            for part in s.get("allOf", []):
                collect(part)

        collect(self._known[kind])
        return list(out)

    def breach(self, data: Column) -> Column:
        """The first rule of its type's schema that a row's data (VARIANT) break, as path and keyword; null for none."""
        out = F.lit("no schema of this type")
        for kind, schema in self._known.items():
            out = F.when(F.col("type") == kind, jsonschema.breach(schema, data)).otherwise(out)
        return out

    def completeness(self, data: Column) -> Column:
        """Share of the fields that its type's schema requires that a row's data have; null for types without a schema."""
        out = F.lit(None).cast("double")
        for kind in self._known:
            out = F.when(F.col("type") == kind, jsonschema.completeness(self.required(kind), data)).otherwise(out)
        return out

    def valid(self) -> Column:
        """Whether a row fits the schema of its type; rows of unknown types do not."""
        out = F.lit(False)
        for kind, schema in self._known.items():
            out = F.when(F.col("type") == kind, schema_check(schema)).otherwise(out)
        return out


def golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, expected entities, expected relationships) of a dataset.json and the files beside it."""
    data = json.loads(Path(path).read_text())
    base = Path(path).parent
    docs = [(d["id"], d["file"], (base / d["file"]).read_text(), d.get("title")) for d in data.get("documents", [])]
    kinds = [(e["type"], e["name"]) for e in data.get("expectedEntities", [])]
    links = [(r["relationshipType"], r["sourceName"], r["targetName"]) for r in data.get("expectedRelationships", [])]
    return (
        spark.createDataFrame(docs, "id string, file string, content string, title string"),
        spark.createDataFrame(kinds, "type string, name string"),
        spark.createDataFrame(links, "type string, source string, target string"),
    )


def labels_outside(labels: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Labels that are none of the values; a dataset is sound if there are none."""
    return labels.where(~F.coalesce(F.col(column).isin(*values), F.lit(False)))


def promote(stage: str, stable: str, keep: bool = True) -> str | None:
    """Put a finished stage in the place of the stable folder; the old one is kept under a number. Local folders."""
    old = None
    if os.path.exists(stable):
        if keep:
            n = 1
            while os.path.exists(f"{stable}.{n}"):
                n += 1
            old = f"{stable}.{n}"
            os.replace(stable, old)
        else:
            shutil.rmtree(stable)
    os.replace(stage, stable)
    return old
