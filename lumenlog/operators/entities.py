"""Entities: mentions, get-or-create, links, normalisation, revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.text import canon_entity_type, normalize_name
from lumenlog.sources.scratch import spread, written


def extract_mentions(notes: DataFrame) -> DataFrame:
    """`(note_id, entity_type, name, strength, context)` from payload columns `entities, topics, listening,
    watching, documents, websites` (arrays; missing ones are left out)."""
    spec = {
        "entities": lambda x: (x["type"], x["name"], F.coalesce(x["confidence"], F.lit(0.5)), F.lit(None).cast("string")),
        "topics": lambda x: (F.lit("topic"), x["name"], F.coalesce(x["confidence"], F.lit(0.5)), x["context"]),
        "listening": lambda x: (F.lit("track"), F.concat_ws(" - ", x["artist"], x["track"]), F.lit(0.9), F.lit(None).cast("string")),
        "watching": lambda x: (F.lit("video"), x["title"], F.lit(0.85), F.lit(None).cast("string")),
        "documents": lambda x: (F.lit("document"), x["name"], F.lit(0.9), F.lit(None).cast("string")),
        "websites": lambda x: (F.lit("domain"), x["domain"], F.lit(0.9), x["purpose"]),
    }

    def entry(f):
        def make(x):
            kind, name, strength, context = f(x)
            return F.struct(kind.alias("entity_type"), name.alias("name"), strength.cast("double").alias("strength"), context.alias("context"))

        return make

    arrays = [F.transform(F.coalesce(F.col(c), F.array()), entry(f)) for c, f in spec.items() if c in notes.columns]
    if "listening" in notes.columns:
        artist = lambda x: F.struct(F.lit("artist").alias("entity_type"), x["artist"].alias("name"), F.lit(0.9).alias("strength"), F.lit(None).cast("string").alias("context"))
        arrays.append(F.transform(F.coalesce(F.col("listening"), F.array()), artist))
    rows = notes.select("note_id", F.explode(F.concat(*arrays)).alias("m")).select("note_id", canon_entity_type(F.col("m.entity_type")).alias("entity_type"), "m.name", "m.strength", "m.context")
    return rows.where("name is not null and trim(name) <> ''")


def entity_key(kind, name):
    """A stable id from type and normalised name."""
    return F.sha2(F.concat_ws("|", kind, normalize_name(name)), 256)


def upsert_entities(mentions: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """One entity per (type, normalised name); other spellings become aliases, joined with those known before."""
    rows = mentions.select("entity_type", normalize_name(F.col("name")).alias("canonical_name"), F.array(F.trim("name")).alias("names"))
    if base is not None:
        rows = rows.unionByName(base.select("entity_type", "canonical_name", F.col("aliases").alias("names")))
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list("names"))))
    out = rows.where("canonical_name <> ''").groupBy("entity_type", "canonical_name").agg(names.alias("names"))
    key = F.sha2(F.concat_ws("|", "entity_type", "canonical_name"), 256)
    return out.select(key.alias("entity_id"), "entity_type", "canonical_name", F.filter("names", lambda x: x != F.col("canonical_name")).alias("aliases"))


def upsert_links(mentions: DataFrame, order: str = "seq") -> DataFrame:
    """One link per note and entity: the greatest strength and the newest context there is."""
    return mentions.groupBy("note_id", "entity_id").agg(F.max("strength").alias("strength"), F.max_by("context", F.when(F.col("context").isNotNull(), F.col(order))).alias("context"))


def resolve_chains(mapping: DataFrame, rounds: int = 20) -> DataFrame:
    """`(variant, canonical)` followed to the end, A to B to C; a mapping that leads back to itself is rejected."""
    live = mapping.where("variant <> canonical").dropDuplicates(["variant"])
    for _ in range(rounds):
        hop = live.select(F.col("variant").alias("canonical"), F.col("canonical").alias("onward"))
        moved = live.join(hop, "canonical", "left").select("variant", F.coalesce("onward", "canonical").alias("canonical"), F.col("onward").isNotNull().alias("moved"))
        moved = written(moved, "chains")
        looped = moved.where("variant = canonical").limit(1).count()
        if looped:
            raise ValueError("mapping has a cycle")
        done = moved.where("moved").limit(1).count() == 0
        live = moved.drop("moved")
        if done:
            return live
    raise ValueError("mapping has a cycle")


def apply_normalizations(mapping: DataFrame, entities: DataFrame, links: DataFrame, edges: DataFrame, of: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Variants give way to their canonical entity in entities (as aliases), links and edges; `mapping(variant, canonical)` of ids.

    With `of`, of which there are at least as many rows as links or edges, both are dealt by its rows before they are
    merged: hardly any become equal, so partial maxima would only hold them all."""
    m = resolve_chains(mapping)
    merged = entities.join(m, F.col("entity_id") == F.col("variant"), "left").withColumn("into", F.coalesce("canonical", "entity_id"))
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat("aliases", F.when(F.col("variant").isNotNull(), F.array("canonical_name")).otherwise(F.array()))))))
    kept = merged.groupBy(F.col("into").alias("entity_id")).agg(F.max(F.when(F.col("variant").isNull(), F.col("entity_type"))).alias("entity_type"), F.max(F.when(F.col("variant").isNull(), F.col("canonical_name"))).alias("canonical_name"), names.alias("aliases"))
    to = lambda df, c: df.join(m, F.col(c) == F.col("variant"), "left").withColumn(c, F.coalesce("canonical", c)).drop("variant", "canonical")
    dealt = lambda df, *keys: df if of is None else spread(df, *keys, of=of)
    moved = dealt(to(links, "entity_id"), "note_id").groupBy("note_id", "entity_id").agg(F.max("strength").alias("strength"), F.max("context").alias("context"))
    repointed = dealt(to(to(edges, "from_id"), "to_id").where("from_id <> to_id"), "from_id", "to_id", "edge_type").groupBy("from_id", "to_id", "edge_type").agg(F.max("weight").alias("weight"))
    return kept, moved, repointed


def search_entities(entities: DataFrame, part: str, kind: str | None = None, n: int | None = 20) -> DataFrame:
    """Entities whose name or an alias holds a text, ignoring case."""
    low = part.lower()
    rows = entities.where(F.lower("canonical_name").contains(low) | F.exists("aliases", lambda x: F.lower(x).contains(low)))
    if kind:
        rows = rows.where(F.col("entity_type") == kind)
    return rows if n is None else rows.orderBy("canonical_name", "entity_id").limit(n)


def entities_for_notes(links: DataFrame, entities: DataFrame, notes: DataFrame) -> DataFrame:
    """Entities of the given notes with their strength."""
    return links.join(notes.select("note_id"), "note_id", "left_semi").join(entities, "entity_id").select("note_id", "entity_id", "entity_type", "canonical_name", "strength")


def apply_revisions(notes: DataFrame, revisions: DataFrame) -> DataFrame:
    """Revised summary where there is one; revised entities first, then original ones not among them (ignoring
    case); context appended after a full stop. `notes(note_id, summary, entities)`, `revisions(note_id, new_summary, new_entities, context)`."""
    rows = notes.join(revisions, "note_id", "left")
    new = F.coalesce("new_entities", F.array().cast("array<string>"))
    lowered = F.transform(new, F.lower)
    names = F.concat(new, F.filter(F.coalesce("entities", F.array().cast("array<string>")), lambda x: ~F.array_contains(lowered, F.lower(x))))
    base = F.coalesce("new_summary", "summary", F.lit(""))
    joined = F.when(F.col("context").isNull() | (F.col("context") == ""), base).when(base == "", F.col("context")).otherwise(F.concat(F.regexp_replace(base, r"\.?\s*$", ". "), "context"))
    return rows.select("note_id", joined.alias("summary"), names.alias("entities"))
