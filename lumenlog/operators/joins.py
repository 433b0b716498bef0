"""Interval, resolution and existence joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.sources.scratch import written

_HOUR = "interval 1 hour"


def _buckets(start: Column, end: Column) -> Column:
    trunc = lambda c: F.date_trunc("hour", c).cast("timestamp_ntz")
    return F.explode(F.sequence(trunc(start), trunc(end), F.expr(_HOUR)))


def point_in_span_join(points: DataFrame, spans: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Every point with the spans of its key that hold it ([start, end)); points without one have nulls.

    Spans are dealt to hour buckets, so this is an equi join on (key, hour) with a residual range test."""
    held = spans.select(key, "span_id", "start_ts", "end_ts", _buckets(F.col("start_ts"), F.col("end_ts")).alias("bucket"))
    dealt = points.withColumn("bucket", F.date_trunc("hour", ts).cast("timestamp_ntz"))
    p, s = dealt.alias("p"), held.alias("s")
    cond = (F.col(f"p.{key}") == F.col(f"s.{key}")) & (F.col("p.bucket") == F.col("s.bucket")) & (F.col(f"p.{ts}") >= F.col("s.start_ts")) & (F.col(f"p.{ts}") < F.col("s.end_ts"))
    return p.join(s, cond, "left").select("p.*", "s.span_id", "s.start_ts", "s.end_ts").drop("bucket")


def resolve(names: DataFrame, entities: DataFrame, mode: str = "exact") -> DataFrame:
    """Names to entities, ignoring case. exact: canonical name before aliases, smallest id; contains: all
    entities whose canonical name or alias holds the name."""
    known = entities.select("entity_id", F.lower("canonical_name").alias("known"), F.lit(0).alias("rank")).unionByName(entities.select("entity_id", F.explode("aliases").alias("known"), F.lit(1).alias("rank")).withColumn("known", F.lower("known")))
    asked = names.select("name", F.lower("name").alias("asked"))
    if mode == "exact":
        rows = asked.join(known, F.col("asked") == F.col("known"), "left")
        return rows.groupBy("name").agg(F.min(F.when(F.col("entity_id").isNotNull(), F.struct("rank", "entity_id")))["entity_id"].alias("entity_id"))
    held = held_pairs(asked.select("asked"), known.select("known"))
    return asked.join(held, "asked").join(known, "known").select("name", "entity_id").distinct()


def _grams(text: Column, n: int) -> Column:
    """All substrings of `n` characters; none of shorter texts."""
    cut = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, cut).otherwise(F.array().cast("array<string>"))


def held_pairs(parts: DataFrame, wholes: DataFrame, by: tuple[str, ...] = (), grams: int = 3) -> DataFrame:
    """Distinct pairs `(*by, asked, known)` where the text `known` of `wholes` holds the text `asked` of `parts`.

    Each asked text is looked up by the one of its `grams` character substrings (itself if it is shorter) that the
    fewest known texts hold, so only these are tested. Null and empty texts are in no pair."""
    one = wholes.where("known <> ''").select(*by, "known").distinct()
    dealt = one.select(*by, "known", F.explode(F.array_distinct(F.concat(*[_grams(F.col("known"), n) for n in range(1, grams + 1)]))).alias("gram"))
    counts = dealt.groupBy(*by, "gram").agg(F.count("*").alias("n"))
    asked = parts.where("asked <> ''").select(*by, "asked").distinct()
    own = F.when(F.length("asked") < grams, F.array("asked")).otherwise(F.array_distinct(_grams(F.col("asked"), grams)))
    keyed = asked.select(*by, "asked", F.explode(own).alias("gram")).join(counts, [*by, "gram"], "left")
    rarest = keyed.groupBy(*by, "asked").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    return rarest.join(dealt, [*by, "gram"]).where(F.col("known").contains(F.col("asked"))).select(*by, "asked", "known")


def notes_for_entities(notes: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """Notes of the given entities with their strongest link."""
    rows = links.join(entities.select("entity_id"), "entity_id", "left_semi").groupBy("note_id").agg(F.max("strength").alias("strength"))
    return rows.join(notes, "note_id")


def orphan_links(links: DataFrame, entities: DataFrame) -> DataFrame:
    """Links whose entity doesn't exist."""
    return links.join(entities.select("entity_id"), "entity_id", "left_anti")


def endpoints(edges: DataFrame) -> DataFrame:
    """Both ends of every edge, with their role."""
    return edges.select("*", F.explode(F.array(F.struct(F.lit("from").alias("role"), F.col("from_id").alias("id")), F.struct(F.lit("to").alias("role"), F.col("to_id").alias("id")))).alias("end")).select("*", "end.role", "end.id").drop("end")


def orphan_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Ends of edges that name no entity."""
    return endpoints(edges).join(entities.select(F.col("entity_id").alias("id")), "id", "left_anti")


def induced_edges(edges: DataFrame, nodes: DataFrame, min_weight: float = 0.0) -> DataFrame:
    """Edges with both ends among the nodes."""
    kept = edges.where(F.col("weight") >= min_weight)
    return kept.join(nodes.select(F.col("entity_id").alias("from_id")), "from_id", "left_semi").join(nodes.select(F.col("entity_id").alias("to_id")), "to_id", "left_semi")


def degree(edges: DataFrame, entities: DataFrame, min_weight: float = 0.0) -> DataFrame:
    """Edges that touch each entity; a loop counts once."""
    ends = endpoints(edges.where(F.col("weight") >= min_weight)).where("not (role = 'to' and from_id = to_id)").groupBy(F.col("id").alias("entity_id")).agg(F.count("*").alias("degree"))
    return entities.select("entity_id").join(ends, "entity_id", "left").select("entity_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def neighbors(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges at the given entities seen from them, with the direction."""
    out = edges.select(F.col("from_id").alias("entity_id"), F.col("to_id").alias("other_id"), "edge_type", "weight", F.lit("out").alias("direction"))
    into = edges.where("from_id <> to_id").select(F.col("to_id").alias("entity_id"), F.col("from_id").alias("other_id"), "edge_type", "weight", F.lit("in").alias("direction"))
    return out.unionByName(into).join(ids.select("entity_id"), "entity_id", "left_semi")


def edges_for(edges: DataFrame, ids: DataFrame, direction: str = "both", types: list[str] | None = None, min_weight: float = 0.0) -> DataFrame:
    """Edges that start or end at the given entities, each once."""
    kept = edges.where(F.col("weight") >= min_weight)
    if types:
        kept = kept.where(F.col("edge_type").isin(types))
    parts = []
    if direction in ("both", "out"):
        parts.append(kept.join(ids.select(F.col("entity_id").alias("from_id")), "from_id", "left_semi"))
    if direction in ("both", "in"):
        parts.append(kept.join(ids.select(F.col("entity_id").alias("to_id")), "to_id", "left_semi"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.dropDuplicates(["from_id", "to_id", "edge_type"])


def apply_blocklist(df: DataFrame, blocklist: DataFrame, app: str = "app_id", domain: str = "domain") -> DataFrame:
    """rows with `blocked_by` (null: allowed): an enabled entry for the app, or for the domain or one above it.

    Domains become their suffixes, so this is an equi join; the pattern of the smallest name is reported."""
    live = blocklist.where("enabled").select("block_type", F.lower("pattern").alias("pattern"))
    apps = live.where("block_type = 'app'").select(F.col("pattern").alias("a_pattern")).distinct()
    domains = live.where("block_type = 'domain'").select(F.col("pattern").alias("suffix")).distinct()
    parts = F.split(F.coalesce(F.col(domain), F.lit("")), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    names = df.select(domain).where(f"{domain} is not null and {domain} <> ''").distinct().select(F.col(domain).alias("d"), F.explode(suffixes).alias("suffix")).join(domains, "suffix")
    hit = names.groupBy("d").agg(F.min("suffix").alias("d_pattern"))
    rows = df.join(apps, F.lower(app) == F.col("a_pattern"), "left").join(hit, F.col(domain) == F.col("d"), "left")
    return rows.withColumn("blocked_by", F.coalesce(F.concat(F.lit("app:"), "a_pattern"), F.concat(F.lit("domain:"), "d_pattern"))).drop("a_pattern", "d", "d_pattern")


def _chars(name: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(name, ""), lambda c: (c != "") & (c != " "))))


def _alike_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs `(entity_type, set_a, set_b)` of character sets, a set with itself among them, that reach the similarity.

    Two such sets share one of the rarest m - ceil(threshold * m) + 1 characters of each, and their sizes are within
    the threshold of each other; only sets that meet in such a character are compared."""
    letters = sets.select("entity_type", "chars", F.explode("chars").alias("char"))
    rarity = letters.groupBy("entity_type", "char").agg(F.count("*").alias("n"))
    ranked = letters.join(rarity, ["entity_type", "char"]).groupBy("entity_type", "chars").agg(F.array_sort(F.collect_list(F.struct("n", "char"))).alias("order"))
    m = F.size("chars")
    prefix = F.slice("order", 1, m - F.ceil(m * threshold - 1e-9).cast("int") + 1)
    keys = ranked.select("entity_type", "chars", m.alias("m"), F.explode(F.transform(prefix, lambda x: x["char"])).alias("char"))
    a = keys.select("entity_type", "char", F.col("chars").alias("set_a"), F.col("m").alias("m_a"))
    b = keys.select("entity_type", "char", F.col("chars").alias("set_b"), F.col("m").alias("m_b"))
    near = F.least("m_a", "m_b") >= F.greatest("m_a", "m_b") * threshold - 1e-9
    pairs = a.join(b, ["entity_type", "char"]).where((F.col("set_a") <= F.col("set_b")) & near).select("entity_type", "set_a", "set_b").distinct()
    return pairs.where(F.size(F.array_intersect("set_a", "set_b")) / F.size(F.array_union("set_a", "set_b")) >= threshold)


def similar_pairs(names: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs of names of one type whose similarity reaches the threshold (above 0).

    One holding the other: 0.9; else the Jaccard similarity of their characters (without blanks). Names are compared
    after folding equal ones (ignoring case); null and empty ones are in no pair. Candidates meet by a shared rare
    substring or a shared rare character, never by their type alone."""
    one = names.select("entity_type", F.lower("name").alias("name")).where("entity_type is not null and name <> ''").distinct()
    keyed = one.withColumn("chars", _chars(F.col("name")))
    sets = _alike_sets(keyed.select("entity_type", "chars").distinct(), threshold)
    a = keyed.select("entity_type", F.col("name").alias("x"), F.col("chars").alias("set_a"))
    b = keyed.select("entity_type", F.col("name").alias("y"), F.col("chars").alias("set_b"))
    alike = sets.join(a, ["entity_type", "set_a"]).join(b, ["entity_type", "set_b"]).select("entity_type", "x", "y")
    held = held_pairs(one.withColumnRenamed("name", "asked"), one.withColumnRenamed("name", "known"), ("entity_type",)).select("entity_type", F.col("asked").alias("x"), F.col("known").alias("y"))
    pairs = alike.unionByName(held).where("x <> y").select("entity_type", F.least("x", "y").alias("name_a"), F.greatest("x", "y").alias("name_b")).distinct()
    contains = F.col("name_a").contains(F.col("name_b")) | F.col("name_b").contains(F.col("name_a"))
    left, right = _chars(F.col("name_a")), _chars(F.col("name_b"))
    either = F.size(F.array_union(left, right))
    score = F.when(contains, F.lit(0.9)).when(either == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(left, right)) / either)
    return pairs.withColumn("similarity", score).where(F.col("similarity") >= threshold)


def potential_duplicates(entities: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Groups of entities of one type that may be the same: `(group_id, entity_id, entity_type, canonical_name)`.

    Two entities are linked if any of their names (canonical or alias, ignoring case) are equal or reach the
    similarity of J12; groups are the connected components, named by their smallest id; single entities are left out.
    Entities that share a name are linked to the first of them, so a frequent name adds one link an entity."""
    from lumenlog.operators.graph import components

    all_names = F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    names = entities.select("entity_id", "entity_type", F.explode(all_names).alias("name")).select("entity_id", "entity_type", F.lower("name").alias("name")).where("entity_type is not null and name <> ''").distinct()
    first = names.groupBy("entity_type", "name").agg(F.min("entity_id").alias("first_id"))
    equal = names.join(first, ["entity_type", "name"]).select(F.col("entity_id").alias("a"), F.col("first_id").alias("b"))
    ends = lambda c, to: first.select("entity_type", F.col("name").alias(c), F.col("first_id").alias(to))
    alike = similar_pairs(names, threshold).join(ends("name_a", "a"), ["entity_type", "name_a"]).join(ends("name_b", "b"), ["entity_type", "name_b"]).select("a", "b")
    groups = components(equal.unionByName(alike).where("a <> b"))
    return groups.select(F.col("node").alias("entity_id"), F.col("component").alias("group_id")).join(entities.select("entity_id", "entity_type", "canonical_name"), "entity_id").select("group_id", "entity_id", "entity_type", "canonical_name")


def levenshtein_pairs(names: DataFrame, k: int) -> DataFrame:
    """J12 by edits: pairs of different names of one type, ignoring case, at most `k` edits apart: `(entity_type, name_a, name_b, distance)`.

    A name is cut into k+1 segments. Of a name within k edits one segment is left whole, moved by k places at most, so
    every pair meets at (length of the shorter one, segment, its text): the shorter looks up nothing, the longer its own
    pieces of those lengths. What meets is verified with a bound. Null and empty names are in no pair."""
    one = names.select("entity_type", F.lower("name").alias("name")).where("entity_type is not null and name <> ''").distinct()
    one = one.withColumn("n", F.length("name"))
    cut = lambda n, i: F.floor(n * i / (k + 1)).cast("int")  # noqa: E731  where segment i of a name of n characters begins
    own = F.array(*[F.struct(F.lit(i).alias("i"), F.substring("name", cut(F.col("n"), i) + 1, cut(F.col("n"), i + 1) - cut(F.col("n"), i)).alias("part")) for i in range(k + 1)])
    index = one.select("entity_type", F.col("name").alias("x"), F.col("n").alias("length"), F.explode(own).alias("s")).select("entity_type", "x", "length", "s.i", "s.part")
    tries = F.explode(F.array(*[F.struct((F.col("n") - less).alias("length"), F.lit(i).alias("i"), F.lit(by).alias("by")) for less in range(k + 1) for i in range(k + 1) for by in range(-k, k + 1)]))
    asked = one.select("entity_type", F.col("name").alias("y"), "n", tries.alias("t")).select("entity_type", "y", "n", "t.*").where("length > 0")
    at = cut(F.col("length"), F.col("i")) + F.col("by")
    size = cut(F.col("length"), F.col("i") + 1) - cut(F.col("length"), F.col("i"))
    asked = asked.where((at >= 0) & (at + size <= F.col("n"))).select("entity_type", "y", "length", "i", F.substring("y", at + 1, size).alias("part")).distinct()
    met = index.join(asked, ["entity_type", "length", "i", "part"]).where("x <> y").select("entity_type", F.least("x", "y").alias("name_a"), F.greatest("x", "y").alias("name_b")).distinct()
    return met.withColumn("distance", F.levenshtein("name_a", "name_b", k)).where("distance >= 0")


def greedy_groups(entities: DataFrame, threshold: float = 0.8, max_rounds: int = 10_000) -> DataFrame:
    """E05, greedy: `(group_id, entity_id, entity_type, canonical_name)`, groups of two or more, named by their first entity.

    In the order of (canonical name, id), an entity that no earlier group has takes all later ones of its type that
    are like it by any of their names (equal, or similar by J12) and not yet taken. What is like a member but not like
    the first stays out, so unlike names don't chain up as in `potential_duplicates`.

    An entity leads a group unless an earlier leader is like it. In rounds, every open entity that comes before all
    open ones like it leads, and those like it are closed; at the end each goes to its earliest leader, as in a loop.
    Least ranks pass through names, an entity's to its names, a name's to those like it and back: pairs of entities
    are never made, whatever they share. Rounds are about as many as the longest run of ever later entities each like
    the one before."""
    every = F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    ranked = entities.select("entity_id", "entity_type", "canonical_name", F.struct("canonical_name", "entity_id").alias("rank"), every.alias("every"))
    names = written(ranked.select("entity_id", "entity_type", "rank", F.explode("every").alias("name")).select("entity_id", "entity_type", "rank", F.lower("name").alias("name")).where("entity_type is not null and name <> ''").distinct(), "names")
    pairs = similar_pairs(names.select("entity_type", "name"), threshold)
    own = names.select("entity_type", "name", F.col("name").alias("other"))
    both = pairs.select("entity_type", F.col("name_a").alias("name"), F.col("name_b").alias("other"))
    near = written(both.unionByName(both.select("entity_type", F.col("other").alias("name"), F.col("name").alias("other"))).unionByName(own).distinct(), "near")

    def least(of: DataFrame) -> DataFrame:
        """`(entity_id, least)`: the least rank among the entities `of` that an entity is like, itself included."""
        held = names.join(of, "entity_id", "left_semi").groupBy("entity_type", "name").agg(F.min("rank").alias("r"))
        over = near.join(held.withColumnRenamed("name", "other"), ["entity_type", "other"]).groupBy("entity_type", "name").agg(F.min("r").alias("r"))
        return names.join(over, ["entity_type", "name"]).groupBy("entity_id").agg(F.min("r").alias("least"), F.first("rank").alias("rank"))

    still = names.select("entity_id").distinct()
    leaders = None
    for _ in range(max_rounds):
        led = written(least(still).join(still, "entity_id", "left_semi").where("least = rank").select("entity_id"), "led")
        if led.isEmpty():
            break
        leaders = led if leaders is None else written(leaders.unionByName(led), "leaders")
        still = written(still.join(least(led).select("entity_id"), "entity_id", "left_anti"), "still")
    else:
        raise RuntimeError(f"groups did not settle in {max_rounds} rounds")
    if leaders is None:
        return ranked.select(F.col("entity_id").alias("group_id"), "entity_id", "entity_type", "canonical_name").limit(0)
    groups = written(least(leaders).select("entity_id", F.col("least.entity_id").alias("group_id")), "groups")
    several = groups.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    return groups.join(several, "group_id").join(ranked.select("entity_id", "entity_type", "canonical_name"), "entity_id").select("group_id", "entity_id", "entity_type", "canonical_name")
