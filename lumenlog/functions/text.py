"""Scalar columns: names, domains, JSON repair, canonical types, fingerprints, rule tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical entity and edge types, and the aliases accepted for them.
ENTITY_TYPES = ["topic", "app", "domain", "document", "artist", "track", "video", "person", "project", "game"]
ENTITY_ALIASES = {"song": "track", "music": "track", "website": "domain", "site": "domain", "url": "domain", "file": "document", "pdf": "document", "doc": "document", "application": "app", "program": "app"}
EDGE_TYPES = ["ABOUT_TOPIC", "WATCHED", "LISTENED_TO", "USED_APP", "VISITED_DOMAIN", "DOC_REFERENCE", "CO_OCCURRED_WITH", "STUDIED_WHILE"]

# `\b` of Java and Python takes other than ASCII letters for word signs or not, by version; these don't.
WORD_START, WORD_END = r"(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])", r"(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])"


def canon_entity_type(col: Column) -> Column:
    """a known type, the type an alias stands for, else topic."""
    low = F.lower(F.trim(col))
    alias = F.create_map(*[F.lit(x) for pair in ENTITY_ALIASES.items() for x in pair])
    return F.when(low.isin(ENTITY_TYPES), low).otherwise(F.coalesce(alias[low], F.lit("topic")))


def canon_edge_type(col: Column) -> Column:
    """a known edge type, else CO_OCCURRED_WITH."""
    up = F.upper(F.trim(col))
    return F.when(up.isin(EDGE_TYPES), up).otherwise(F.lit("CO_OCCURRED_WITH"))


def normalize_name(col: Column) -> Column:
    """lower case, white space collapsed, non-word signs dropped at both ends."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(col), r"\s+", " ")), r"^[^0-9A-Za-z_]+|[^0-9A-Za-z_]+$", "")


def extract_domain(col: Column) -> Column:
    """host of a URL (or its first path part without a scheme), without port, lower case; '' if there is none."""
    host = F.regexp_extract(F.lower(F.coalesce(col, F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?([^/?#]*)", 1)
    return F.regexp_replace(host, r":\d+$", "")


def repair_json(col: Column) -> Column:
    """code fences dropped, then cut to the outermost braces; unchanged if there are none."""
    plain = F.regexp_replace(F.regexp_replace(col, r"```[a-z]*", ""), r"```", "")
    inner = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    return F.when(inner != "", inner).otherwise(F.trim(plain))


def extract_mention(col: Column) -> Column:
    """what follows about/on/regarding, without trailing words of time."""
    got = F.regexp_extract(col, rf"(?i){WORD_START}(?:about|regarding|related to)\s+(.+?)\s*[?.!]*$", 1)
    return F.trim(F.regexp_replace(got, r"(?i)\s+(?:today|yesterday|this week|last week|this month|last month|recently)$", ""))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-digit hex fingerprints, eight digits at a time."""
    part = lambda c, i: F.conv(F.substring(c, 8 * i + 1, 8), 16, 10).cast("long")
    total = F.lit(0)
    for i in range(8):
        total = total + F.bit_count(part(a, i).bitwiseXOR(part(b, i)))
    return total.cast("int")


def diff_score(distance: Column, bits: int = 256) -> Column:
    """The distance as a share of all bits, 1 at most."""
    return F.least(F.lit(1.0), distance / F.lit(float(bits)))


def first_match(col: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """the label of the first rule (label, pattern) that matches."""
    out = F.lit(default)
    for label, pattern in reversed(rules):
        out = F.when(col.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def word(text: str) -> str:
    r"""The pattern of a word, ignoring case, between ASCII word boundaries, as RE2 (and DuckDB) have `\b` there."""
    return f"(?i){WORD_START}{text}{WORD_END}"


def classify_text(col: Column, rules: dict[str, list[str]], weight: float = 0.4, threshold: float = 0.4, fallback: str = "simple", missing: str | None = None) -> Column:
    """the class with most matching patterns, score min(1, weight*hits); below the threshold the fallback.

    Ties go to the class named first; a null text is `missing` (None: the fallback)."""
    names = list(rules)
    hits = [sum((col.rlike(p).cast("int") for p in rules[n]), F.lit(0)) for n in names]
    best = F.array_max(F.array(*[F.struct(F.least(F.lit(1.0), h * F.lit(weight)).alias("score"), F.lit(-i).alias("rank"), F.lit(n).alias("label")) for i, (n, h) in enumerate(zip(names, hits, strict=True))]))
    label = F.when(best["score"] >= threshold, best["label"]).otherwise(F.lit(fallback))
    return F.when(col.isNull(), F.lit(fallback if missing is None else missing)).otherwise(label)
