"""Personal data (native): candidates by patterns, boosted trees over format and context, calibrated thresholds. Columns only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import materialize, table

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive and with a look behind, so that a long word is read once; \G: right after the match before.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_IP_OK = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"
#: Further forms in which such data are written. They propose; the model decides.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?[(\[{]at[)\]}] ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?[(\[{]dot[)\]}] ?)[A-Za-z0-9-]{1,63}){1,8}| at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{1,63}){1,8})",
    "ip": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ ./_-]{0,2}[0-9]){12,18}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:00[1-9][0-9]{0,2}[ .-]?)?\(?[0-9]{2,4}\)?(?:[ .-]\(?[0-9]{2,4}\)?){1,4}(?![0-9A-Za-z])",
}
#: Text that must be there for the pattern to be tried at all.
_NEEDS = {
    "email": "(t rlike r'[(\\[{]at[)\\]}]' or contains(t, ' dot '))",
    "ip": "(contains(t, '::') or contains(t, '[.]') or t rlike r'[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:')",
    "card": "t rlike '[0-9]'",
    "phone": "t rlike '[0-9]'",
}
_AT = r"[^\s@]{0,64}@[^\s@]{0,64}"  # what is written with an @ and is no address: what the model learns not to take
#: Words before a span that tell its kind.
CUES = {
    "email": "mail|contact|kontakt|correo|courriel",
    "ip": r"\bip\b|addr|host|server",
    "card": "card|visa|karte|tarjeta|carte",
    "phone": "tel|phone|call|fax|mobil|handy|appel",
}
FEATURES = ("kind", "digits", "groups", "marks", "luhn", "before", "after", "cue", "form")
LEVELS = (4, 9, 6, 4, 2, 4, 4, 3, 2)  # of each feature: the driver gets a row for each combination at most
ROUNDS, RATE, RIDGE = 36, 0.4, 4.0
HELD_OUT = 10  # one document in so many calibrates
PRECISION, LEAST_LOGIT = 0.99, math.log(9.0)  # of what is taken of the held-out candidates of a kind; nine in ten by the model
SPAN = "struct<kind:int,start:bigint,end:bigint>"


def _let(value: str, name: str, then: str) -> str:
    """`then` with `name` bound to `value`: computed once, however often it is named."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def _found(pattern: str, when: str) -> str:
    """SQL: all matches of a pattern in `t` from the left, with place (code points, end exclusive) and surroundings.

    `split` and `regexp_extract_all` walk the same matches; a place is the sum of the lengths before it. Those sums go
    in blocks of the square root of the matches, so a text with very many takes n*sqrt(n) additions, not n*n."""
    block = "cast(ceil(sqrt(v.n)) as int)"
    sums = _let(
        f"named_struct('p', v.p, 'm', v.m, 'n', v.n, 'w', v.w, 'b', {block}, 's', transform(sequence(0, v.n div {block}), k -> aggregate(sequence(k * {block}, (k + 1) * {block} - 1), 0L, (a, j) -> a + coalesce(get(v.w, j), 0L))))",
        "u",
        _let(
            "named_struct('u', u, 'o', transform(u.s, (x, k) -> if(k = 0, 0L, aggregate(sequence(0, greatest(0, k - 1)), 0L, (a, j) -> a + u.s[j]))))",
            "z",
            "transform(z.u.m, (x, i) -> "
            + _let(
                "z.o[i div z.u.b] + if(i % z.u.b = 0, 0L, aggregate(sequence(i - i % z.u.b, greatest(i - i % z.u.b, i - 1)), 0L, (a, j) -> a + z.u.w[j])) + length(z.u.p[i])",
                "at",
                "named_struct('start', at, 'end', at + length(x), 'hit', x, 'before', right(z.u.p[i], 32), 'after', left(z.u.p[i + 1], 4))",
            )
            + ")",
        ),
    )
    none = "cast(array() as array<struct<start:bigint,end:bigint,hit:string,before:string,after:string>>)"
    raw = _let(
        f"named_struct('p', split(t, r'{pattern}', -1), 'm', regexp_extract_all(t, r'{pattern}', 0))",
        "r",
        _let("named_struct('p', r.p, 'm', r.m, 'n', size(r.m), 'w', transform(r.m, (x, i) -> cast(length(x) + length(r.p[i]) as bigint)))", "v", f"if(v.n = 0, {none}, {sums})"),
    )
    return f"if({when}, {raw}, {none})"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """SQL: does a string of 1 to 19 digits pass the Luhn check?"""
    step = "(a, i) -> a + (cast(substr(q, i, 1) as int) * if((length(q) - i) % 2 = 1, 2, 1)) div 10 + (cast(substr(q, i, 1) as int) * if((length(q) - i) % 2 = 1, 2, 1)) % 10"
    return _let(digits, "q", f"aggregate(sequence(1, length(q)), 0L, {step}) % 10 = 0")


def _valid(kind: str, x: str) -> str:
    """SQL: does a match of the base pattern count?"""
    if kind == "email":
        return "true"
    if kind == "ip":
        return f"{x} rlike r'{_IP_OK}'"
    low, high = (13, 19) if kind == "card" else (9, 15)
    return _let(_digits(x), "g", f"length(g) between {low} and {high}" + (f" and {_luhn('g')}" if kind == "card" else ""))


def _side(x: str, end: str) -> str:
    """SQL: what stands beside a span: white space or nothing, other marks, marks of code, a word."""
    at = f"{x}$" if end == "before" else f"^{x}"
    value = "x.before" if end == "before" else "x.after"
    mark = lambda c: at.replace(x, c)
    return f"case when {value} = '' or {value} rlike r'{mark(r'[\x20\t-\r]')}' then 0 when {value} rlike r'{mark(r'[\p{L}\p{N}_]')}' then 3 when {value} rlike r'{mark('[=/#\"]')}' then 2 else 1 end"


def _features(kind: str) -> str:
    """SQL: the features of a match `x` as small numbers. None of them is the rule that makes a base span one."""
    k = KINDS.index(kind)
    others = "|".join(v for q, v in CUES.items() if q != kind)
    form = {
        "email": "x.hit rlike '[A-Za-z]{2,12}$' and x.hit rlike r'[@)\\]}]|\\bat\\b'",
        "ip": f"x.hit rlike r'{_IP_OK}' or contains(x.hit, ':') or replace(replace(x.hit, '[', ''), ']', '') rlike r'{_IP_OK}'",
        "card": "not x.hit rlike '[ ./_-]{2}'",
        "phone": "not x.hit rlike '[0-9]{5}'",
    }[kind]
    digits = "case when n = 0 then 0 when n <= 6 then 1 when n <= 8 then 2 when n <= 11 then 3 when n = 12 then 4 when n <= 15 then 5 when n = 16 then 6 when n <= 19 then 7 else 8 end"
    return _let(
        _digits("x.hit"),
        "h",
        _let(
            "length(h)",
            "n",
            f"""named_struct('kind', {k}, 'digits', {digits}, 'groups', least(5, size(regexp_extract_all(x.hit, '[0-9]+', 0))),
            'marks', case when x.hit rlike '[()]' then 3 when x.hit rlike '[.:]' then 2 when x.hit rlike '[ -]' then 1 else 0 end,
            'luhn', if(n between 12 and 19, cast({_luhn("h")} as int), 0), 'before', {_side("~", "before")}, 'after', {_side("~", "after")},
            'cue', case when lower(x.before) rlike r'{CUES[kind]}' then 2 when lower(x.before) rlike r'{others}' then 1 else 0 end, 'form', cast({form} as int))""",
        ),
    )


def _meets(spans: str, x: str) -> str:
    """SQL: does span `x` meet one of `spans`, which are in order and don't overlap? By bisection."""
    half = "shiftright(s.lo + s.hi, 1)"
    below = f"aggregate(sequence(0, cast(log2(size({spans})) as int) + 1), named_struct('lo', 0, 'hi', size({spans})), (s, i) -> case when s.lo >= s.hi then s when {spans}[{half}].start < {x}.end then named_struct('lo', {half} + 1, 'hi', s.hi) else named_struct('lo', s.lo, 'hi', {half}) end, s -> s.lo)"
    return f"(size({spans}) > 0 and " + _let(below, "b", f"b > 0 and {spans}[b - 1].end > {x}.start") + ")"


def candidates(docs: DataFrame) -> DataFrame:
    """Columns of `docs` and, from its `text`: `base` (spans of the base patterns by kind, then start), `known` (features
    of all matches of those and whether they count) and `proposed` (further spans with features, none meeting a base span)."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    row = F.struct(*names).alias("row")
    out = docs.select(row, F.coalesce(F.col("text"), F.lit("")).alias("t"))
    tried = {"email": "contains(t, '@')", "ip": "t rlike '[0-9][.]'", "card": "t rlike '[0-9]'", "phone": "contains(t, '+')"}
    out = out.select("row", "t", *[F.expr(f"transform({_found(BASE[k], tried[k])}, x -> named_struct('x', x, 'ok', {_valid(k, 'x.hit')}))").alias(f"all_{k}") for k in KINDS])
    out = out.select("*", *[F.expr(f"transform(filter(all_{k}, y -> y.ok), y -> named_struct('kind', {KINDS.index(k)}, 'start', y.x.start, 'end', y.x.end))").alias(k) for k in KINDS])
    # The base spans are bound to a variable: named inside a function, they would be found anew for each element.
    free = " and ".join(f"not {_meets(f'held.{k}', 'x')}" for k in KINDS)
    held = f"named_struct({', '.join(f"'{k}', {k}" for k in KINDS)})"
    known = [f"transform(all_{k}, y -> {_let('y.x', 'x', f"named_struct('f', {_features(k)}, 'ok', y.ok)")})" for k in KINDS]
    known.append(_let("email", "held", f"transform(filter({_found(_AT, tried['email'])}, x -> not {_meets('held', 'x')}), x -> named_struct('f', {_features('email')}, 'ok', false))"))
    made = "named_struct('kind', {0}, 'start', x.start, 'end', x.end, 'f', {1})"
    new = [_let(held, "held", f"transform(filter({_found(LOOSE[k], _NEEDS[k])}, x -> {free}), x -> {made.format(i, _features(k))})") for i, k in enumerate(KINDS)]
    base = f"concat({', '.join(KINDS)})"
    return out.select("row", F.expr(base).alias("base"), F.expr(f"concat({', '.join(known)})").alias("known"), F.expr(f"concat({', '.join(new)})").alias("proposed"))


# The model ------------------------------------------------------------------------------------------------------------

Row = tuple[tuple[int, ...], float, float]  # features, and how often such a candidate counts and does not


@dataclass
class Trees:
    """Trees of two levels: (feature, most, left, right), where a side is (feature, most, value, value); thresholds by kind (logits)."""

    trees: list[tuple]
    start: float
    thresholds: tuple[float, ...]

    def logit(self, f: tuple[int, ...]) -> float:
        total = self.start
        for a, t, left, right in self.trees:
            b, u, low, high = left if f[a] <= t else right
            total += low if f[b] <= u else high
        return total

    def taken(self, f: str) -> str:
        """SQL: is a candidate with the features `f` (a struct) taken?"""
        side = lambda s: f"if({f}.{FEATURES[s[0]]} <= {s[1]}, {s[2]!r}D, {s[3]!r}D)"
        total = " + ".join([f"{self.start!r}D", *(f"if({f}.{FEATURES[a]} <= {t}, {side(x)}, {side(y)})" for a, t, x, y in self.trees)])
        least = f"element_at(array({', '.join(f'{v!r}D' for v in self.thresholds)}), {f}.kind + 1)"
        return f"({total}) >= {least}"


def boost(rows: list[Row], held: list[Row], rounds: int = ROUNDS) -> Trees | None:
    """Gradient boosting with the logistic loss over counted feature combinations; thresholds from `held`.

    Each round leaves one feature out in turn, so format and context both get their say. For each kind the threshold is
    the least logit, at least LEAST_LOGIT, from which on PRECISION of the held-out candidates count."""
    pos, neg = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if pos == 0:
        return None
    start = math.log((pos + 1) / (neg + 1))
    score, trees = [start] * len(rows), []
    for turn in range(rounds if neg else 0):
        p = [1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) for s in score]
        grad = [r[1] - (r[1] + r[2]) * q for r, q in zip(rows, p, strict=True)]
        hess = [(r[1] + r[2]) * q * (1 - q) for r, q in zip(rows, p, strict=True)]
        usable = [a for a in range(len(FEATURES)) if a != turn % len(FEATURES)]

        def best(at: list[int], usable=usable, grad=grad, hess=hess) -> tuple[int, int, float]:
            top = (usable[0], LEVELS[usable[0]], 0.0)
            g, h = sum(grad[i] for i in at), sum(hess[i] for i in at)
            for a in usable:
                gs, hs = [0.0] * LEVELS[a], [0.0] * LEVELS[a]
                for i in at:
                    gs[rows[i][0][a]] += grad[i]
                    hs[rows[i][0][a]] += hess[i]
                gl = hl = 0.0
                for t in range(LEVELS[a] - 1):
                    gl, hl = gl + gs[t], hl + hs[t]
                    gain = gl * gl / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g * g / (h + RIDGE)
                    if gain > top[2] + 1e-9:
                        top = (a, t, gain)
            return top

        everything = list(range(len(rows)))
        a, t, _ = best(everything)
        sides = []
        for part in ([i for i in everything if rows[i][0][a] <= t], [i for i in everything if rows[i][0][a] > t]):
            b, u, _ = best(part)
            value = [RATE * sum(grad[i] for i in s) / (sum(hess[i] for i in s) + RIDGE) for s in ([i for i in part if rows[i][0][b] <= u], [i for i in part if rows[i][0][b] > u])]
            sides.append((b, u, *(round(v, 6) for v in value)))
        trees.append((a, t, *sides))
        for i in everything:
            b, u, low, high = sides[0] if rows[i][0][a] <= t else sides[1]
            score[i] += low if rows[i][0][b] <= u else high
    model = Trees(trees, round(start, 6), ())
    thresholds = []
    for k in range(len(KINDS)):
        ranked = sorted(((model.logit(f), p, n) for f, p, n in held if f[0] == k), reverse=True)
        least, p_sum, n_sum = math.inf, 0.0, 0.0
        for i, (s, p, n) in enumerate(ranked):
            p_sum, n_sum = p_sum + p, n_sum + n
            if (i + 1 == len(ranked) or ranked[i + 1][0] < s) and p_sum >= PRECISION * (p_sum + n_sum) and p_sum > 0:
                least = s
        thresholds.append(round(max(LEAST_LOGIT, least), 6) if math.isfinite(least) else 1e9)
    return Trees(trees, model.start, tuple(thresholds))


def train(found: DataFrame, doc_id: str = "row.doc_id") -> Trees | None:
    """Boosted trees from the matches of `candidates`: all documents are counted, and the driver gets one row for each
    combination of features (a bounded number), apart for the documents that calibrate. None if no match counts."""
    fold = (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % HELD_OUT == 0).alias("held")
    rows = found.where("size(known) > 0").select(fold, F.explode("known").alias("x"))
    counted = rows.groupBy("held", "x.f").agg(F.sum(F.col("x.ok").cast("long")).alias("p"), F.count("*").alias("n")).collect()
    parts: dict[bool, list[Row]] = {True: [], False: []}
    for r in sorted(counted, key=lambda r: (r["held"], tuple(r["f"]))):
        parts[r["held"]].append((tuple(r["f"]), float(r["p"]), float(r["n"] - r["p"])))
    return boost(parts[False], parts[True])


def chosen(model: Trees | None) -> Column:
    """`spans` from the columns of `candidates`: all base spans, and the proposed ones that the model takes; by kind, then start."""
    if model is None:
        return F.col("base")
    more = f"transform(filter(proposed, c -> {_let('c.f', 'f', model.taken('f'))}), c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.end))"
    return F.expr(f"array_sort(concat(base, {more}))")


def listed(spans: str) -> Column:
    """Spans as `kind:start:end`, joined by commas."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.end)), ',')")


def find_personal_data(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """`row` (the columns of `docs` in a struct), `base` and `spans`: arrays of (kind, start, end), kinds numbered as in KINDS.

    Base spans are the matches of the base patterns from the left, without overlap within a kind, that count (parts of
    an address up to 255, cards of 13 to 19 digits that pass the Luhn check, phones of 9 to 15 digits). Looser forms
    are proposed besides; a model that boosted trees over digits, groups, marks, check digits, surroundings and words
    before, and that was trained on what counts and what doesn't among the base matches, takes those which it finds
    likely enough; they never meet a base span but may meet each other.

    Null text is empty, with no spans. Rows that repeat or share an id are searched each; null ids are allowed; other
    columns, also of clashing names, stay in `row`. Texts are read whole, in time about linear in their length.
    Nothing found, or an empty table: no model, base spans only. No shuffle but that of the counted features.
    """
    found = candidates(docs)
    return found.select("row", "base", chosen(model or train(found)).alias("spans"))


def redact(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """The rows of `docs` with each run of overlapping spans in `text` replaced by its first kind in brackets (`[email]`).

    A text is cut at its spans, which costs its length for each of them. Texts without spans stay; a null text too."""
    names = ", ".join(f"'[{k}]'" for k in KINDS)
    spans = find_personal_data(docs, model).select("row", F.expr("array_sort(transform(spans, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind)))").alias("s"))
    cut = f"""aggregate(s, named_struct('out', '', 'at', 0L), (a, x) -> case
        when x.start >= a.at then named_struct('out', concat(a.out, substring(row.text, cast(a.at + 1 as int), cast(x.start - a.at as int)), element_at(array({names}), x.kind + 1)), 'at', x.end)
        else named_struct('out', a.out, 'at', greatest(a.at, x.end)) end, a -> concat(a.out, substring(row.text, cast(a.at + 1 as int))))"""
    text = F.when(F.size("s") == 0, F.col("row.text")).otherwise(F.expr(cut))
    return spans.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = candidates(docs).select(F.struct("row.doc_id").alias("row"), "base", "known", "proposed")
    kept = materialize(found, "candidates")
    spans = kept.select("row.doc_id", "base", chosen(train(kept)).alias("spans"))
    count = lambda k: F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as bigint)")
    return spans.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))
