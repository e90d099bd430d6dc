"""Entity resolution: exact merges, candidate blocks, supplied groups, and edges after merges.

entities: id, type, name, confidence, evidence (array), ord (arrival).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_filled, normalise_name
from ..plans.tables import numbered, settled
from . import setjoin
from .graph import components

SIMILAR, MOST_IN_BLOCK = 0.67, 40


def resolve_exact(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(survivors, remap id -> survivor) by type and normalised name.

    The first to arrive survives with the union of the evidence and the largest confidence; entities
    without a name go by id, so they never merge. Aggregates only: a hot name is combined map-side.
    """
    keyed = entities.withColumn("_key", normalise_name(first_filled(F.col("name"), F.col("id"))))
    evidence = F.array_distinct(F.flatten(F.collect_set("evidence")))
    merged = keyed.groupBy("type", "_key").agg(F.min(F.struct("ord", "id", "name")).alias("_first"), F.max("confidence").alias("confidence"), F.sort_array(evidence).alias("evidence"), F.count(F.lit(1)).alias("members"))
    survivors = merged.select(F.col("_first.id").alias("id"), "type", F.col("_first.name").alias("name"), "confidence", "evidence", "members")
    heads = merged.where("members > 1").select("type", "_key", F.col("_first.id").alias("survivor"))
    remap = keyed.join(heads, ["type", "_key"]).where("id <> survivor").select("id", "survivor")
    return survivors, remap


def _label(entities: DataFrame) -> Column:
    return first_filled(F.col("name"), F.col("id"))


def _classes(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, type, key; type, key, rep): the digest of each row's token set, and the smallest id of each set."""
    keyed = settled(setjoin.digests(entities, _label(entities)), "keyed")
    return keyed, settled(keyed.groupBy("type", "key").agg(F.min("id").alias("rep")), "classes")


def _members(keyed: DataFrame, classes: DataFrame) -> DataFrame:
    return keyed.join(classes, ["type", "key"]).where("id <> rep").select("type", "rep", "id")


def class_members(entities: DataFrame) -> DataFrame:
    """type, rep, id of every other entity with its representative's type and token set."""
    return _members(*_classes(entities))


def similar_links(entities: DataFrame, least: float = SIMILAR) -> DataFrame:
    """a, b, similarity, kind: pairs of representatives ("pair") and each member under its representative ("member").

    Two entities are similar exactly if their representatives are one or make a pair, so no link is lost.
    """
    keyed, classes = _classes(entities)
    members = _members(keyed, classes).select("type", F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"), F.lit("member").alias("kind"))
    return setjoin.similar(entities, _label(entities), classes, least).withColumn("kind", F.lit("pair")).unionByName(members)


def similar_pairs(entities: DataFrame, least: float = SIMILAR) -> DataFrame:
    """a, b, similarity of same-type representatives with enough salient tokens in common, each pair once.

    Equal token sets are one class first, so copies never pair up with each other (see ``class_members``).
    """
    return setjoin.similar(entities, _label(entities), _classes(entities)[1], least)


def candidate_blocks(entities: DataFrame, least: float = SIMILAR, most: int = MOST_IN_BLOCK) -> DataFrame:
    """component, block, id: groups of similar names of up to ``most``; a last one that would be alone joins the block before."""
    links = settled(similar_links(entities, least).select("a", "b"), "links")
    found = components(links).join(entities.select("id", _label(entities).alias("name")), "id")
    w = Window.partitionBy("component")
    n, all_of = F.row_number().over(w.orderBy("name", "id")) - 1, F.count(F.lit(1)).over(w)
    block = F.floor(n / most)
    folded = F.when((block > 0) & (n == all_of - 1) & (n % most == 0), block - 1).otherwise(block)
    return found.select("component", folded.cast("int").alias("block"), "id")


def adjudicated(groups: DataFrame, entities: DataFrame) -> DataFrame:
    """group, id of supplied groups (group, ids): known ids once each, groups of two and more only."""
    ids = groups.select("group", F.explode(F.array_distinct("ids")).alias("id")).join(entities.select("id"), "id", "left_semi")
    first = ids.groupBy("id").agg(F.min("group").alias("group"))  # an id stays with its first group
    counted = first.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return first.join(counted.select("group"), "group", "left_semi").select("group", "id")


def merge_groups(entities: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(survivors with aliases, remap) after merging groups (group, id, canonical): the most confident of a group survives."""
    both = entities.join(groups, "id")
    best = both.groupBy("group").agg(
        F.max(F.struct("confidence", (-F.col("ord")).alias("o"), "id", "name", "type")).alias("_b"),
        F.max("canonical").alias("canonical"),
        F.max("confidence").alias("confidence"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("evidence")))).alias("evidence"),
        F.sort_array(F.collect_set("name")).alias("names"),
    )
    name = F.coalesce("canonical", F.col("_b.name"))
    merged = best.select("group", F.col("_b.id").alias("id"), F.col("_b.type").alias("type"), name.alias("name"), "confidence", "evidence", F.array_except("names", F.array(name)).alias("aliases"))
    remap = both.select("group", "id").join(merged.select("group", F.col("id").alias("survivor")), "group").where("id <> survivor").select("id", "survivor")
    rest = entities.join(groups.select("id"), "id", "left_anti").select("id", "type", "name", "confidence", "evidence", F.array().cast("array<string>").alias("aliases"))
    return rest.unionByName(merged.drop("group")), remap


def remap_edges(edges: DataFrame, remap: DataFrame) -> DataFrame:
    """type, source_id, target_id, id (first), evidence (union): edges on survivors, without loops and repeats."""
    s = remap.select(F.col("id").alias("source_id"), F.col("survivor").alias("_s"))
    t = remap.select(F.col("id").alias("target_id"), F.col("survivor").alias("_t"))
    moved = edges.join(s, "source_id", "left").join(t, "target_id", "left").withColumns({"source_id": F.coalesce("_s", "source_id"), "target_id": F.coalesce("_t", "target_id")})
    kept = moved.where("source_id <> target_id")
    return kept.groupBy("type", "source_id", "target_id").agg(F.min("id").alias("id"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("evidence")))).alias("evidence"))


def classification_batches(subjects: DataFrame, done: DataFrame, size: int = 40) -> DataFrame:
    """type, batch, id, name of the subjects that have no verdict: batches are cut from all of them by name, whatever their type."""
    todo = subjects.join(done.select(F.col("subject").alias("id")), "id", "left_anti").select("type", "id", "name")
    return numbered(todo, "name", "id", "type").select("type", F.floor(F.col("number") / size).cast("int").alias("batch"), "id", "name")


def valid_verdicts(verdicts: DataFrame) -> DataFrame:
    """Verdicts that name a disposition and a rationale, with an id of their subject; levels other than 2 to 4 are dropped."""
    ok = verdicts.where(F.col("disposition").isin("placed", "rejected") & (F.trim("rationale") != ""))
    return ok.withColumns({"id": F.concat(F.lit("cls-"), F.col("subject")), "level": F.when(F.col("level").between(2, 4), F.col("level")), "confidence": F.when(F.col("confidence").isNull(), 0.5).otherwise(F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)))})


# --- the classification pass ------------------------------------------------------------------------------


def verdict_subjects(verdicts: DataFrame, batches: DataFrame) -> DataFrame:
    """Verdicts (batch, name, ...) for every id (subject) that has the name in their batch; other names say nothing.

    A batch's number names its subjects alone, as batches are not numbered by type.
    """
    asked = batches.select("batch", "name", F.col("id").alias("subject")).distinct()
    return verdicts.join(asked, ["batch", "name"])


def reclassified(kept: DataFrame, new: DataFrame, subjects: DataFrame) -> DataFrame:
    """Earlier classifications of subjects that still live, and the new ones, by id; a new one takes the place of an old one."""
    live = kept.join(subjects.select(F.col("id").alias("subject")), "subject", "left_semi").join(new.select("id"), "id", "left_anti")
    return live.unionByName(new, allowMissingColumns=True).orderBy("id")


def spine_outline(spine: DataFrame) -> DataFrame:
    """name, children (sorted names) of each capability of level 1, with the ones of level 2 that name it as their parent."""
    tops = spine.where("level = 1").select("name").distinct()
    lower = spine.where("level = 2").groupBy(F.col("parent").alias("name")).agg(F.sort_array(F.collect_list("name")).alias("children"))
    return tops.join(lower, "name", "left").select("name", F.coalesce("children", F.array().cast("array<string>")).alias("children")).orderBy("name")


# --- extensions -------------------------------------------------------------------------------------------


def resolution_actions(candidates: DataFrame, merge: float = 0.85, link: float = 0.6) -> DataFrame:
    """id, action, other: merge with the most similar known entity, link to it, or create (candidates: id, other, similarity)."""
    best = candidates.groupBy("id").agg(F.max(F.struct(F.coalesce("similarity", F.lit(0.0)).alias("similarity"), "other")).alias("_b"))
    action = F.when(F.col("_b.similarity") >= merge, "merge").when(F.col("_b.similarity") >= link, "link").otherwise("create")
    return best.select("id", action.alias("action"), F.when(action != "create", F.col("_b.other")).alias("other"))


def _resolved_mentions(mentions: DataFrame, remap: DataFrame) -> DataFrame:
    return mentions.join(remap, "id", "left").select("document", F.coalesce("survivor", "id").alias("id")).distinct()


def cross_document_relationships(mentions: DataFrame, remap: DataFrame) -> DataFrame:
    """document, id, documents: the resolved entities that tie a document to others, and how many documents mention each.

    An entity relates all documents that mention it with each other; they are given as its members, so an entity that a
    third of all documents mention takes as many rows, not their square, and no related pair is lost.
    """
    resolved = _resolved_mentions(mentions, remap)
    often = resolved.groupBy("id").agg(F.count(F.lit(1)).alias("documents")).where("documents > 1")
    return resolved.join(often, "id").select("document", "id", "documents")


def related_documents(mentions: DataFrame, remap: DataFrame, most: int = 100) -> DataFrame:
    """document, other_document, n: pairs of documents that share an entity of at most ``most`` documents, each pair once.

    n counts all entities that both mention, also those of more documents. Pairs that share such alone are not listed:
    they are the members of these entities in ``cross_document_relationships``.
    """
    ties = settled(cross_document_relationships(mentions, remap), "ties")
    few = ties.where(F.col("documents") <= most).select("id", "document")
    other = few.withColumnRenamed("document", "other_document")
    pairs = few.join(other, "id").where("document < other_document").groupBy("document", "other_document").agg(F.count(F.lit(1)).alias("few"))
    many = ties.where(F.col("documents") > most).select("id", "document")
    pairs = settled(pairs, "document-pairs")
    both = pairs.drop("few").join(many, "document").join(many.withColumnRenamed("document", "other_document"), ["other_document", "id"])
    more = both.groupBy("document", "other_document").agg(F.count(F.lit(1)).alias("many"))
    return pairs.join(more, ["document", "other_document"], "left").select("document", "other_document", (F.col("few") + F.coalesce("many", F.lit(0))).alias("n"))
