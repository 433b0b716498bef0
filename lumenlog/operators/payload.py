"""Note payloads: validation with a quarantine, document tagging, texts for embedding and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAYLOAD = "summary string, categories array<string>, activities array<struct<time_start:string,time_end:string,description:string,app:string,category:string>>, topics array<struct<name:string,context:string,confidence:double>>, entities array<struct<name:string,type:string,confidence:double>>, location string, _corrupt string"

# Document kind by app id, and by the end of a window title, first match wins.
DOCUMENT_APPS = {
    "com.apple.Preview": "pdf",
    "com.adobe.Reader": "pdf",
    "com.adobe.Acrobat.Pro": "pdf",
    "com.readdle.PDFExpert-Mac": "pdf",
    "net.sourceforge.skim-app.skim": "pdf",
    "com.qoppa.pdfstudio": "pdf",
    "com.apple.iWork.Pages": "pages",
    "com.microsoft.Word": "word",
    "com.apple.iWork.Numbers": "spreadsheet",
    "com.microsoft.Excel": "spreadsheet",
    "com.apple.iWork.Keynote": "presentation",
    "com.microsoft.Powerpoint": "presentation",
    "com.apple.TextEdit": "text",
    "com.sublimetext.4": "code",
    "com.sublimetext.3": "code",
    "com.microsoft.VSCode": "code",
    "com.jetbrains.intellij": "code",
    "com.jetbrains.pycharm": "code",
    "com.jetbrains.webstorm": "code",
    "com.panic.Nova": "code",
    "com.barebones.bbedit": "code",
    "io.brackets.appshell": "code",
    "com.github.atom": "code",
    "abnerworks.Typora": "markdown",
    "com.electron.obsidian": "markdown",
    "md.obsidian": "markdown",
    "net.ia.writer": "markdown",
    "com.typora": "markdown",
    "com.apple.iBooksX": "ebook",
    "com.amazon.Kindle": "ebook",
}
TITLE_KINDS = [
    (r"\.pdf(\s|$|\]|\))", "pdf"),
    (r"\.docx?(\s|$|\]|\))", "word"),
    (r"\.xlsx?(\s|$|\]|\))", "spreadsheet"),
    (r"\.pptx?(\s|$|\]|\))", "presentation"),
    (r"\.pages(\s|$|\]|\))", "pages"),
    (r"\.numbers(\s|$|\]|\))", "spreadsheet"),
    (r"\.key(\s|$|\]|\))", "presentation"),
    (r"\.txt(\s|$|\]|\))", "text"),
    (r"\.md(\s|$|\]|\))", "markdown"),
    (r"\.rtf(\s|$|\]|\))", "text"),
    (r"\.(py|js|ts|jsx|tsx|java|c|cpp|h|rs|go|rb|php|swift|kt)(\s|$|\]|\))", "code"),
    (r"\.epub(\s|$|\]|\))", "ebook"),
]
#: Ends of titles of online documents, paths and file names in titles.
ONLINE_KINDS = [(r"Google Docs$", "gdoc"), (r"Google Sheets$", "gsheet"), (r"Google Slides$", "gslides")]
FILE_PATH = r"(/(?:Users|Volumes|private|tmp)[^\s\[\]]+|~/[^\s\[\]]+)"
FILE_NAMES = [r"^([^-\[\]]+\.[a-zA-Z]{2,5})\s*[-\u2014]\s*", r"[-\u2014]\s*([^-\[\]]+\.[a-zA-Z]{2,5})$", r"^([^/\\\s\[\]]+\.[a-zA-Z]{2,5})$"]
APP_SURE, TITLE_SURE, PATH_SURE, ONLINE_SURE, LEAST_SURE = 0.8, 0.7, 0.9, 0.85, 0.5


def validate_payloads(notes: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine) of notes with a JSON text: missing lists and texts get defaults, a missing confidence
    is 0.5; what isn't JSON, has no summary, a confidence outside [0, 1] or a time that isn't HH:MM is set aside."""
    rows = notes.withColumn("p", F.from_json(payload, PAYLOAD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    empty = lambda c: F.coalesce(F.col(f"p.{c}"), F.array())
    good_time = lambda c: c.isNull() | c.rlike(r"^([01]?\d|2[0-3]):[0-5]\d$")
    sure = lambda c: F.forall(empty(c), lambda x: F.coalesce(x["confidence"], F.lit(0.5)).between(0.0, 1.0))
    times = F.forall(empty("activities"), lambda a: good_time(a["time_start"]) & good_time(a["time_end"]))
    problem = (
        F.when(F.col("p").isNull() | F.col("p._corrupt").isNotNull(), "not JSON")
        .when(F.trim(F.coalesce("p.summary", F.lit(""))) == "", "no summary")
        .when(~(sure("topics") & sure("entities")), "confidence")
        .when(~times, "time")
    )
    rows = rows.withColumn("problem", problem)
    default = lambda c: F.transform(empty(c), lambda x: x.withField("confidence", F.coalesce(x["confidence"], F.lit(0.5))))
    keep = [c for c in notes.columns if c != payload]
    valid = rows.where("problem is null").select(*keep, F.col("p.summary").alias("summary"), empty("categories").alias("categories"), empty("activities").alias("activities"), default("topics").alias("topics"), default("entities").alias("entities"), F.col("p.location").alias("location"))
    return valid, rows.where("problem is not null").select(*keep, payload, "problem")


def _first(title: Column, rules: list[tuple[str, str]], flags: str = "") -> Column:
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(rules):
        out = F.when(title.rlike(flags + pattern), kind).otherwise(out)
    return out


def tag_documents(df: DataFrame, app: str = "app_id", title: str = "window_title") -> DataFrame:
    """`document_type, document_path, document_confidence, is_document` from the app, the title and a path or file
    name in it, by all patterns; a row is of a document if its type is known and the confidence suffices."""
    t = F.coalesce(F.col(title), F.lit(""))
    by_app = F.create_map(*[F.lit(x) for pair in DOCUMENT_APPS.items() for x in pair])[F.coalesce(F.col(app), F.lit(""))]
    by_title, online = _first(t, TITLE_KINDS, "(?i)"), _first(t, ONLINE_KINDS)
    path = document_path(t)
    confidence = F.greatest(F.when(by_app.isNotNull(), APP_SURE).otherwise(0.0), F.when(by_title.isNotNull(), TITLE_SURE).otherwise(0.0), F.when(path.isNotNull(), PATH_SURE).otherwise(0.0), F.when(online.isNotNull(), ONLINE_SURE).otherwise(0.0))
    kind = F.coalesce(online, by_app, by_title)
    return df.withColumns({"document_type": kind, "document_path": path, "document_confidence": confidence, "is_document": kind.isNotNull() & (confidence >= LEAST_SURE)})


def document_path(title: Column) -> Column:
    """the path that a title holds, or else the file name before, after or without an app's name; null if none."""
    found = [F.regexp_extract(title, p, 1) for p in (FILE_PATH, *FILE_NAMES)]
    return F.coalesce(*[F.when(F.trim(x) != "", F.trim(x)) for x in found])


def embedding_text(valid: DataFrame) -> DataFrame:
    """per note `(note_id, start_ts, summary, categories, activities, topics, entities, location)` the text to embed."""
    part = lambda label, c: F.when(F.length(c) > 0, F.concat(F.lit(label + ": "), c))
    names = lambda c, f: F.array_join(F.transform(F.coalesce(F.col(c), F.array()), f), ", ")
    kinds = F.array_sort(F.array_distinct(F.transform("entities", lambda e: F.coalesce(e["type"], F.lit("topic")))))
    by_kind = F.array_join(F.transform(kinds, lambda k: F.concat(k, F.lit(" "), F.array_join(F.transform(F.filter("entities", lambda e: F.coalesce(e["type"], F.lit("topic")) == k), lambda e: e["name"]), ", "))), "; ")
    text = F.concat_ws("\n", part("Time", F.date_format("start_ts", "yyyy-MM-dd HH:mm")), F.col("summary"), part("Categories", F.array_join("categories", ", ")), part("Activities", F.array_join(F.transform(F.slice("activities", 1, 5), lambda a: a["description"]), "; ")), part("Topics", names("topics", lambda x: x["name"])), part("Entities", by_kind), part("Location", F.coalesce("location", F.lit(""))))
    return valid.select("note_id", text.alias("text"))


def timeline_text(clipped: DataFrame, key: str = "user_id") -> DataFrame:
    """per key and hour one line per span, in order: time, app and title."""
    line = F.concat_ws(" ", F.date_format("clip_start", "HH:mm"), F.coalesce("app_id", F.lit("Unknown")), F.col("window_title"))
    ordered = F.array_sort(F.collect_list(F.struct("clip_start", "event_id", line.alias("line"))))
    return clipped.groupBy(key, "hour").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("timeline"))


def dashboard(spans: DataFrame, events: DataFrame, links: DataFrame, entities: DataFrame) -> dict[str, DataFrame]:
    """The reports of a dashboard over one base; cache `spans` first if it is costly."""
    from lumenlog.operators import rollups as A

    return {"apps": A.app_usage(spans), "topics": A.topic_usage(links, entities), "trend": A.activity_trend(events), "heatmap": A.heatmap(events), "summary": A.productivity_summary(spans, links)}
