"""Frame scoring and selection of keyframes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Category of an app by prefix of its id, first match wins.
APP_CATEGORIES = {
    "com.apple.Preview": "document",
    "com.adobe.Reader": "document",
    "com.microsoft.Word": "document",
    "com.microsoft.Excel": "document",
    "com.microsoft.PowerPoint": "document",
    "com.apple.Safari": "browsing",
    "com.google.Chrome": "browsing",
    "org.mozilla.firefox": "browsing",
    "com.apple.mail": "communication",
    "com.microsoft.Outlook": "communication",
    "com.tinyspeck.slackmacgap": "communication",
    "com.apple.MobileSMS": "communication",
    "us.zoom.xos": "communication",
    "com.spotify.client": "media",
    "com.apple.Music": "media",
    "com.apple.TV": "media",
    "tv.plex.": "media",
    "com.apple.Xcode": "creative",
    "com.microsoft.VSCode": "creative",
    "com.jetbrains.": "creative",
    "com.figma.Desktop": "creative",
    "com.adobe.Photoshop": "creative",
    "com.valvesoftware.steam": "gaming",
    "com.apple.finder": "other",
    "com.apple.Terminal": "creative",
}


def app_category(app: Column, categories: dict[str, str] | None = None) -> Column:
    """F16: category of an app id by its first matching prefix, else other."""
    out = F.lit("other")
    for prefix, label in reversed(list((categories or APP_CATEGORIES).items())):
        out = F.when(app.startswith(prefix), label).otherwise(out)
    return out


def triage(frames: DataFrame, categories: dict[str, str] | None = None) -> DataFrame:
    """F16: `category, importance, has_text, has_document, has_media` of frames `(app_id, diff_score)`."""
    c = app_category(F.coalesce("app_id", F.lit("")), categories)
    rows = frames.withColumn("category", c)
    boost = F.when(F.col("category").isin("document", "creative"), 0.1).otherwise(0.0)
    importance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("diff_score", F.lit(0.5)) * 0.6 + 0.2 + boost))
    return rows.withColumns({"importance": F.round(importance, 6), "has_text": F.col("category").isin("document", "browsing", "communication", "creative"), "has_document": F.col("category") == "document", "has_media": F.col("category") == "media"})


def score_frames(frames: DataFrame) -> DataFrame:
    """1 for a transition, 0.6 of the difference, half the importance from 0.3 on, 0.2 for documents, 0.15 for creative apps."""
    worth = F.when(F.col("importance") >= 0.3, F.col("importance") * 0.5).otherwise(0.0)
    kind = F.when(F.col("category") == "document", 0.2).when(F.col("category") == "creative", 0.15).otherwise(0.0)
    score = F.col("is_transition").cast("double") + 0.6 * F.col("diff_score") + worth + kind
    reason = F.when(F.col("is_transition"), "transition").when(F.col("diff_score") >= 0.5, "change").when(F.col("importance") >= 0.3, "importance").otherwise("other")
    return frames.withColumns({"score": F.round(score, 6), "reason": reason})


def select_keyframes(frames: DataFrame, key: list[str], k: int = 15, gap: float = 30.0, anchor: float = 300.0) -> DataFrame:
    """Per group (a key and an hour, so bounded) up to k frames `(frame_id, ts, score)`.

    Greedy by score, ties by time and id, each at least `gap` seconds from all chosen; then, while there is room, the
    frame nearest the middle of each gap of more than `anchor` seconds; in order of time. Frames without a score come last."""
    kind = frames.schema["ts"].dataType.typeName()
    seconds = {"timestamp": F.unix_timestamp("ts"), "timestamp_ntz": F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01', ts)")}.get(kind, F.col("ts"))
    worth = F.coalesce("score", F.lit(float("-inf")))
    item = F.struct((-worth).alias("cost"), seconds.alias("t"), "frame_id", "ts", "score")
    groups = frames.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("rows"))

    far = lambda done, x: ~F.exists(done, lambda y: F.abs(y["t"] - x["t"]) < gap)
    add = lambda done, x: F.when((F.size(done) < k) & far(done, x), F.concat(done, F.array(x))).otherwise(done)
    groups = groups.withColumn("chosen", F.aggregate("rows", F.slice("rows", 1, 0), add))
    groups = groups.withColumn("times", F.array_sort(F.transform("chosen", lambda x: x["t"])))

    ends = F.transform("times", lambda t, i: F.struct(t.alias("a"), F.get("times", i + 1).alias("e")))
    groups = groups.withColumn("gaps", F.filter(ends, lambda g: g["e"] - g["a"] > anchor))
    off = lambda x, g: F.struct(F.abs(x["t"] - (g["a"] + g["e"]) / 2).alias("off"), *[x[c].alias(c) for c in ("t", "frame_id", "ts", "score")])
    middle = lambda g: F.array_min(F.transform(F.filter("rows", lambda x: (x["t"] > g["a"]) & (x["t"] < g["e"])), lambda x: off(x, g)))
    anchors = F.slice(F.filter(F.transform("gaps", middle), lambda x: x.isNotNull()), F.lit(1), F.lit(k) - F.size("chosen"))

    shown = lambda rows, why: F.transform(rows, lambda x: F.struct(*[x[c].alias(c) for c in ("ts", "frame_id", "score")], F.lit(why).alias("why")))
    both = F.array_sort(F.concat(shown(F.col("chosen"), "score"), shown(anchors, "anchor")))
    return groups.select(*key, F.explode(both).alias("x")).select(*key, "x.frame_id", "x.ts", "x.score", "x.why")
