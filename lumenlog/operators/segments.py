"""Segmented scans: what a window ordered over a whole key gives, for keys of any size.

A key is cut into pieces (an hour, a day, a block of ids). Each piece is summed up to one row: its first and last row,
its totals, its last values. A window over those summaries says what every piece finds before and after it; that goes
in as one row before and one behind the piece's own rows, so that windows over (key, piece) see across its borders.
No task orders more than a piece, or one row for each piece of a key; the rows themselves are shuffled once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

BEFORE, OWN, BEHIND = 0, 1, 2


def time_piece(ts: str = "ts", unit: str = "day") -> Column:
    return F.date_trunc(unit, ts)


def block_piece(number: str, size: int = 4096) -> Column:
    return F.floor(F.col(number) / size)


def scan(
    df: DataFrame,
    key: list[str],
    order: list[str],
    piece: Column | None = None,
    lag: dict[str, str] | None = None,
    lead: dict[str, str] | None = None,
    before: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None,
) -> DataFrame:
    """`df` with, per row and in `order` within `key`: for `lag` and `lead` (name: column) the value of the row before
    and after, for `before` (name: column) the sum of all rows before (0 at first), for `last` (name: column) the last
    value that isn't null up to this row.

    `piece` must not fall as `order` rises (default: the day, or for numbers the block, of the first column of `order`). Null keys are a key, null
    pieces come first. Rows that `order` leaves equal come in any order, within their piece; so they must share one.
    """
    lag, lead, before, last = lag or {}, lead or {}, before or {}, last or {}
    if piece is None:
        piece = block_piece(order[0]) if isinstance(df.schema[order[0]].dataType, NumericType) else time_piece(order[0])
    rows = df.withColumns({"__piece": piece, "__at": F.lit(OWN)} | {f"__t_{n}": c for n, c in before.items()} | {f"__l_{n}": c for n, c in last.items()})
    place = F.struct(*order)
    held = lambda names: F.struct(F.lit(True).alias("__is"), *[F.col(c) for c in dict.fromkeys(names.values())])
    summary = [F.max_by(held(lag), place).alias("__last"), F.min_by(held(lead), place).alias("__first")]
    summary += [F.sum(f"__t_{n}").alias(f"__t_{n}") for n in before]
    summary += [F.max_by(f"__l_{n}", F.when(F.col(f"__l_{n}").isNotNull(), place)).alias(f"__l_{n}") for n in last]
    sums = rows.groupBy(*key, "__piece").agg(*summary)
    along = Window.partitionBy(*key).orderBy("__piece")
    past = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = {f"__t_{n}": F.sum(f"__t_{n}").over(past) for n in before} | {f"__l_{n}": F.last(f"__l_{n}", ignorenulls=True).over(past) for n in last}
    borders = sums.select(*key, "__piece", F.lag("__last").over(along).alias("__last"), F.lead("__first").over(along).alias("__first"), *[c.alias(n) for n, c in carried.items()])

    types = {f.name: f.dataType for f in rows.schema}

    def as_rows(side: str, at: int, names: dict[str, str], also: list[str]) -> DataFrame:
        there = set(names.values())
        value = lambda c: F.col(c) if c in (*key, "__piece", *also) else F.lit(at) if c == "__at" else F.col(side).getField(c) if c in there else F.lit(None)
        return borders.where(f"{side} is not null").select(*[value(c).cast(types[c]).alias(c) for c in rows.columns])

    together = rows
    if lag or before or last:
        together = together.unionByName(as_rows("__last", BEFORE, lag, list(carried)))
    if lead:
        together = together.unionByName(as_rows("__first", BEHIND, lead, []))
    w = Window.partitionBy(*key, "__piece").orderBy("__at", *order)
    zero = {n: F.lit(0).cast(types[f"__t_{n}"]) for n in before}
    found = {n: F.lag(c).over(w) for n, c in lag.items()} | {n: F.lead(c).over(w) for n, c in lead.items()}
    found |= {n: F.coalesce(F.sum(f"__t_{n}").over(w.rowsBetween(Window.unboundedPreceding, -1)), zero[n]) for n in before}
    found |= {n: F.last(f"__l_{n}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for n in last}
    out = together.withColumns(found).where(F.col("__at") == OWN)
    return out.drop("__piece", "__at", *[f"__t_{n}" for n in before], *[f"__l_{n}" for n in last])
