"""The typed entity graph as two DataFrames: building edges, expansion, paths, views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.text import canon_edge_type
from lumenlog.operators.joins import degree, induced_edges, neighbors, resolve
from lumenlog.sources.scratch import spread, written

# How far an edge of each type carries relevance.
EDGE_WEIGHTS = {
    "ABOUT_TOPIC": 1.0,
    "CO_OCCURRED_WITH": 0.9,
    "STUDIED_WHILE": 0.85,
    "USED_APP": 0.8,
    "VISITED_DOMAIN": 0.75,
    "DOC_REFERENCE": 0.7,
    "LISTENED_TO": 0.6,
    "WATCHED": 0.6,
}
DEFAULT_WEIGHT = 0.5


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge per (from, to, type): greatest weight, union of evidence, widest range of time."""
    evidence = F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence"))))
    return edges.groupBy("from_id", "to_id", "edge_type").agg(F.max("weight").alias("weight"), evidence.alias("evidence"), F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))


def build_edges(proposals: DataFrame, entities: DataFrame, base: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Proposals `(from_name, to_name, edge_type, weight, evidence, start_ts, end_ts)` to (edges, unresolved ones)."""
    names = proposals.select(F.col("from_name").alias("name")).union(proposals.select("to_name")).distinct()
    ids = resolve(names, entities)
    rows = proposals.join(ids.select(F.col("name").alias("from_name"), F.col("entity_id").alias("from_id")), "from_name", "left").join(ids.select(F.col("name").alias("to_name"), F.col("entity_id").alias("to_id")), "to_name", "left")
    missing = F.col("from_id").isNull() | F.col("to_id").isNull()
    found = rows.where(~missing).select("from_id", "to_id", canon_edge_type(F.col("edge_type")).alias("edge_type"), "weight", "evidence", "start_ts", "end_ts")
    return merge_edges(found if base is None else found.unionByName(base)), rows.where(missing).select("from_name", "to_name", "edge_type")


PAIR_BUCKETS = 1 << 20


def cooccurrence_edges(links: DataFrame, min_support: int = 1, tile: int = 256) -> DataFrame:
    """Pairs of entities that share notes, with the notes they share and a weight relative to the most.

    A note of more than `tile` entities is split in tiles, and each pair of tiles is joined under a key of its own, so
    no task holds the square of a large note; smaller ones are one tile, sent once.

    With `min_support` above 1 entities of fewer notes go before pairs are made, and pairs are first counted by a hash
    into `PAIR_BUCKETS` numbers: only pairs of a number that reaches the support are counted for themselves."""
    one = links.select("note_id", "entity_id").where("note_id is not null and entity_id is not null").distinct()
    if min_support > 1:
        often = one.groupBy("entity_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_support).select("entity_id")
        one = one.join(often, "entity_id", "left_semi")
    one = written(one, "often")
    tiles = F.ceil(F.count("*").over(Window.partitionBy("note_id")) / tile).cast("int")
    dealt = one.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.hash("entity_id"), F.col("tiles")))
    dealt = dealt.select("note_id", "entity_id", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    cells = dealt.select("note_id", "entity_id", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    cells = spread(cells, "note_id", "low", "high", of=one)
    a = cells.select("note_id", "low", "high", F.col("entity_id").alias("from_id"), F.col("tile").alias("from_tile"))
    b = cells.select("note_id", "low", "high", F.col("entity_id").alias("to_id"), F.col("tile").alias("to_tile"))
    pairs = a.join(b, ["note_id", "low", "high"]).where("from_id < to_id and (low = high or from_tile <> to_tile)")
    if min_support > 1:
        number = F.pmod(F.xxhash64("from_id", "to_id"), F.lit(PAIR_BUCKETS)).alias("number")
        full = written(pairs.groupBy(number).agg(F.count("*").alias("n")).where(F.col("n") >= min_support).select("number"), "numbers")
        pairs = pairs.withColumn("number", number).join(F.broadcast(full), "number", "left_semi")  # PAIR_BUCKETS numbers at most
    counts = pairs.groupBy("from_id", "to_id").agg(F.count("*").alias("support")).where(F.col("support") >= min_support)
    top = counts.agg(F.max("support").alias("most"))
    return counts.join(top, F.lit(True)).select("from_id", "to_id", "support", F.round(F.col("support") / F.col("most"), 6).alias("weight"))


def edges_by_type(edges: DataFrame, kinds: list[str], n: int) -> DataFrame:
    """Edges of the given types, the heaviest first."""
    return edges.where(F.col("edge_type").isin(kinds)).orderBy(F.col("weight").desc(), "from_id", "to_id", "edge_type").limit(n)


def expand(seeds: DataFrame, edges: DataFrame, hops: int = 2, min_weight: float = 0.3, n: int = 20, types: list[str] | None = None) -> DataFrame:
    """Entities within `hops` of the seeds: `(entity_id, hop, relevance)`.

    Relevance of an edge: weight times its type's factor, divided by hop+1 (first hop: 1). Each entity keeps the hop
    that reaches it first and the greatest relevance there. One join a hop; each frontier is written
    to the shared folder."""
    factors = F.create_map(*[F.lit(x) for pair in EDGE_WEIGHTS.items() for x in pair])
    live = edges.where(F.col("weight") >= min_weight)
    if types:
        live = live.where(F.col("edge_type").isin(types))
    live = live.select("from_id", "to_id", (F.col("weight") * F.coalesce(factors[F.col("edge_type")], F.lit(DEFAULT_WEIGHT))).alias("pull"))
    both = live.unionByName(live.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "pull"))
    visited = seeds.select("entity_id").distinct().select("entity_id", F.lit(0).alias("hop"), F.lit(1.0).alias("relevance"))
    frontier = visited
    for hop in range(1, hops + 1):
        step = frontier.select(F.col("entity_id").alias("from_id")).join(both, "from_id").groupBy(F.col("to_id").alias("entity_id")).agg(F.max(F.col("pull") / hop).alias("relevance"))
        frontier = step.join(visited.select("entity_id"), "entity_id", "left_anti").select("entity_id", F.lit(hop).alias("hop"), "relevance")
        frontier = written(frontier, "frontier")
        visited = visited.unionByName(frontier)
    return visited.where("hop > 0").select("entity_id", "hop", F.round("relevance", 6).alias("relevance")).orderBy(F.col("relevance").desc(), "hop", "entity_id").limit(n)


def paths(edges: DataFrame, a, b, max_hops: int = 3) -> DataFrame:
    """All shortest paths from `a` to `b` of at most `max_hops` edges, both directions allowed.

    Levels of nodes grow from both ends in turn, each node in one level only, until two levels meet; paths are then
    spelt out from where they meet, level by level, so only nodes on shortest paths are ever part of one. Edges may occur
    several times; only those of a level are made distinct, as all of them would be shuffled for it."""
    both = edges.select("from_id", "to_id").union(edges.select("to_id", "from_id")).where("from_id <> to_id")
    start = lambda x: edges.sparkSession.range(1).select(F.lit(x).alias("at"))
    sides = [[start(a)], [start(b)]]
    seen = [sides[0][0], sides[1][0]]
    meet = start(a).where(F.lit(a) == F.lit(b))
    hops = 0
    while hops < max_hops and (hops > 0 or a != b):
        side = hops % 2
        step = sides[side][-1].join(both, F.col("at") == F.col("from_id")).select(F.col("to_id").alias("at")).distinct()
        sides[side].append(written(step.join(seen[side], "at", "left_anti")))
        seen[side] = seen[side].union(sides[side][-1])
        meet = sides[0][-1].join(sides[1][-1], "at", "left_semi")
        hops += 1
        if not meet.isEmpty():
            break
    found = meet.select(F.array("at").alias("path"))
    for level in reversed(sides[0][:-1]):
        back = both.join(level, F.col("from_id") == F.col("at"), "left_semi").distinct()
        found = found.join(back, F.col("path")[0] == F.col("to_id")).select(F.concat(F.array("from_id"), "path").alias("path"))
    for level in reversed(sides[1][:-1]):
        onward = both.join(level, F.col("to_id") == F.col("at"), "left_semi").distinct()
        found = found.join(onward, F.element_at("path", -1) == F.col("from_id")).select(F.array_append("path", F.col("to_id")).alias("path"))
    return found.select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("hops"))


def components(links: DataFrame) -> DataFrame:
    """Connected components of `(a, b)`: `(node, component)`, named by the smallest node; joins and aggregations alone.

    Each round takes the least label of the neighbours and then the label of the label, until nothing changes; each is
    written to the shared folder."""
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = both.groupBy("a").agg(F.least("a", F.min("b")).alias("label"))
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), F.col("label").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        step = labels.join(near, "a").select("a", F.least("label", "near").alias("label"), F.col("label").alias("before"))
        onward = step.select(F.col("a").alias("label"), F.col("label").alias("onward"))
        moved = written(step.join(onward, "label").select("a", F.least("label", "onward").alias("label"), "before"))
        labels = moved.select("a", "label")
        if moved.where("label <> before").isEmpty():
            return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))


def entity_context(entity, edges: DataFrame, links: DataFrame, notes: DataFrame, n: int = 10) -> DataFrame:
    """One row: numbers of outgoing and incoming edges and the newest notes of an entity."""
    out = edges.where(F.col("from_id") == F.lit(entity)).agg(F.count("*").alias("n_out"))
    into = edges.where(F.col("to_id") == F.lit(entity)).agg(F.count("*").alias("n_in"))
    latest = links.where(F.col("entity_id") == F.lit(entity)).join(notes, "note_id").orderBy(F.col("start_ts").desc(), "note_id").limit(n)
    ids = latest.agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("start_ts", (-F.col("note_id")).alias("k"), "note_id")))), lambda x: x["note_id"].cast("string")), ",").alias("notes"))
    return out.join(into, F.lit(True)).join(ids, F.lit(True))


def graph_view(entities: DataFrame, edges: DataFrame, links: DataFrame, notes: DataFrame, n: int = 50, min_weight: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """The top entities by degree, then by their notes (those with either), and the edges among them.

    Links are made distinct in a step of its own: a distinct count holds one more table of them in the same task."""
    one = links.join(notes.select("note_id"), "note_id", "left_semi").select("note_id", "entity_id").distinct()
    in_notes = one.groupBy("entity_id").agg(F.count("*").alias("c"))
    rows = degree(edges, entities, min_weight).join(in_notes, "entity_id", "left").select("entity_id", "degree", F.coalesce("c", F.lit(0)).cast("long").alias("notes")).where("degree > 0 or notes > 0")
    top = rows.orderBy(F.col("degree").desc(), F.col("notes").desc(), "entity_id").limit(n)
    return top, induced_edges(edges, top, min_weight)


def entity_details(entity: DataFrame, edges: DataFrame, entities: DataFrame, n: int = 20) -> DataFrame:
    """The heaviest neighbours of an entity, with their names."""
    rows = neighbors(edges, entity).join(entities.select(F.col("entity_id").alias("other_id"), "canonical_name"), "other_id")
    return rows.select("other_id", "canonical_name", "edge_type", "direction", "weight").orderBy(F.col("weight").desc(), "other_id", "edge_type", "direction").limit(n)
