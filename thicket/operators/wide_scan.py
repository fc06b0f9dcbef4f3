"""Running medians and MADs along a draw order that is too long for one task.

Positions are cut into chunks, and a key's values, in order, into ranges of as many
elements. How many elements of each range lie before each chunk is a small table, so a
chunk's task knows for each of its prefixes in which range the median lies, and at which
place there; the range's elements, dealt to the chunks that ask for them, tell the value.

The least interval around a median that holds half of a prefix can be bracketed by
ranges as well: those that lie wholly inside are counted, and only the ranges at its two
ends have to be looked at. Ranges of one value tell theirs without being looked at.
Between the brackets lie the elements of a few ranges at most, whatever the values are
like, so no task holds more than a few times ``size`` of them.

The table has a row a range and chunk, so a small ``size`` is raised for a long key: its
chunks are ``CHUNKS`` at most, until they are of ``SIZE`` positions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.operators.numbered import numbered
from thicket.operators.prefix_order import PrefixOrder, Prefixes, running

#: Most positions of a chunk; chunks of a key whose chunks are smaller; ranges for as many elements as a chunk has positions.
SIZE, CHUNKS, FINER = 250_000, 64, 8


def fitting(longest: int, size: int) -> int:
    """Positions of a chunk for keys of up to ``longest`` positions: ``size``, or more as long as that many chunks were too many."""
    return max(size, min(SIZE, -(-longest // CHUNKS)))


def first_with(enough, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The first i from start to stop with ``enough(i)``, which stays true from there on, or stop."""
    low, high = start, np.maximum(start, stop)
    while (low < high).any():
        mid = (low + high) // 2
        yes = enough(mid)
        low, high = np.where((low < high) & ~yes, mid + 1, low), np.where((low < high) & yes, mid, high)
    return low


class Ranges:
    """What a chunk knows: its own elements by range, how many of each range lie before it, and each range's least and largest value."""

    def __init__(self, pdf: pd.DataFrame, table: pd.DataFrame) -> None:
        table = table.sort_values("j")
        self.low, self.high = table["low"].to_numpy(float), table["high"].to_numpy(float)
        self.base = np.concatenate([[0], np.cumsum(table["before"].to_numpy(np.int64))])
        self.one = self.low == self.high
        own = pdf["j"].to_numpy(float)
        real = ~np.isnan(own)
        self.own = PrefixOrder(own[real].astype(np.int64), len(table))
        self.mine = np.concatenate([[0], np.cumsum(real)])[:-1]  # elements of the chunk before each of its positions
        self.n = self.base[-1] + self.mine

    def below(self, j: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Elements of each prefix in ranges below j."""
        j = np.clip(j, 0, len(self.low))
        return self.base[j] + self.own.below(self.mine[rows], j)

    def holding(self, place: np.ndarray) -> np.ndarray:
        """The range that holds the element at a place (from 0) of each prefix."""
        low, high = np.zeros(len(place), np.int64), np.full(len(place), len(self.low) - 1)
        while (low < high).any():
            mid = (low + high) // 2
            beyond = self.below(mid + 1) <= place
            low, high = np.where((low < high) & beyond, mid + 1, low), np.where((low < high) & ~beyond, mid, high)
        return low

    def inside(self, m: np.ndarray, d: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Elements in ranges that lie wholly within d of m."""
        a, b = np.searchsorted(self.low, m - d, "left"), np.searchsorted(self.high, m + d, "right")
        return np.where(b > a, self.below(b, rows) - self.below(a, rows), 0)

    def touched(self, m: np.ndarray, d: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Elements in ranges that reach nearer to m than d."""
        a, b = np.searchsorted(self.high, m - d, "right"), np.searchsorted(self.low, m + d, "left")
        return np.where(b > a, self.below(b, rows) - self.below(a, rows), 0)

    def bracket(self, m: np.ndarray, first: np.ndarray, last: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the deviations from m at places ``first`` to ``last`` (from 0), by the ends of ranges."""
        r = len(self.low)

        def search(value, enough, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
            return first_with(lambda i: enough(value(np.minimum(i, r - 1))), start, stop)

        holds = lambda d: self.inside(m, d, rows) > last
        exceeds = lambda d: self.touched(m, d, rows) > first
        upper = np.maximum(np.abs(m - self.low[0]), np.abs(self.high[-1] - m))  # holds all
        # Up from m by the ranges' upper ends, down by their lower ends (numbered from m's side).
        at = np.searchsorted(self.high, m, "left")
        i = search(lambda k: self.high[k] - m, holds, at, np.full(len(m), r))
        upper = np.where(i < r, np.minimum(upper, self.high[np.minimum(i, r - 1)] - m), upper)
        down = np.searchsorted(self.low, m, "right")  # ranges that begin at m or below
        i = search(lambda k: m - self.low[np.maximum(down - 1 - k, 0)], holds, np.zeros(len(m), np.int64), down)
        upper = np.where(i < down, np.minimum(upper, m - self.low[np.maximum(down - 1 - i, 0)]), upper)
        # The same for the nearest ends beyond which there may be too many.
        lower = np.zeros(len(m))
        at = np.searchsorted(self.low, m, "left")
        i = search(lambda k: self.low[k] - m, exceeds, at, np.full(len(m), r)) - 1
        lower = np.where(i >= at, np.maximum(lower, self.low[np.clip(i, 0, r - 1)] - m), lower)
        down = np.searchsorted(self.high, m, "right")
        i = search(lambda k: m - self.high[np.maximum(down - 1 - k, 0)], exceeds, np.zeros(len(m), np.int64), down) - 1
        lower = np.where(i >= 0, np.maximum(lower, m - self.high[np.clip(down - 1 - i, 0, r - 1)]), lower)
        return lower, upper

    def kept(self, m: np.ndarray, first: np.ndarray, last: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Bounds of the deviations from m at places ``first`` to ``last``, the ranges l1 to l2 and r1 to r2 with elements that lie
        between the bounds, and how many lie in the ranges between those.

        What lies at a bound is told by it, however much that is, and needs no range.
        """
        r = len(self.low)
        lower, upper = self.bracket(m, first, last, rows)
        begin, end = np.zeros(len(m), np.int64), np.full(len(m), r)
        at = lambda x, i: x[np.minimum(i, r - 1)]
        seek = lambda enough: first_with(enough, begin, end)
        count = lambda a, b: np.where(b > a, self.below(b, rows) - self.below(a, rows), 0)
        # Sums of doubles may be off by their last bits; bounds that fail by differences are moved out by more than that.
        off = 4 * np.spacing(np.maximum(np.abs(m), upper))
        held = count(seek(lambda i: m - at(self.low, i) <= upper), seek(lambda i: at(self.high, i) - m > upper))
        near = count(seek(lambda i: m - at(self.high, i) < lower), seek(lambda i: at(self.low, i) - m >= lower))
        upper, lower = np.where(held > last, upper, upper + off), np.where(near <= first, lower, np.maximum(lower - off, 0.0))
        l1, l2 = seek(lambda i: m - at(self.high, i) < upper), seek(lambda i: m - at(self.low, i) <= lower) - 1
        r1, r2 = seek(lambda i: at(self.high, i) - m > lower), seek(lambda i: at(self.low, i) - m >= upper) - 1
        meet = l2 >= r1 - 1
        skip = np.where(meet, 0, count(l2 + 1, r1))
        return lower, upper, l1, np.where(meet, r2, l2), np.where(meet, r2 + 1, r1), r2, skip


def wide_running(cells: DataFrame, by: Sequence[str], size: int = SIZE) -> DataFrame:
    """``by, k, median, mad`` of the first k values of each key, for all k from 0 to its number of positions.

    ``cells`` has ``by`` (not null), positions ``k`` from 0 on without gaps, and ``value``; null
    values don't count. 0 of none, and MAD 0 of fewer than two. The same numbers as those of
    ``kernel.running`` give. Each step's table is cut off in the checkpoint folder.
    """
    by = list(by)
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    key_sql = ", ".join(f"{c} {kinds[c]}" for c in by)
    ends = cells.groupBy(*by).agg((F.max("k") + 1).cast("long").alias("k")).withColumn("value", F.lit(None).cast("double"))
    size = fitting(ends.agg(F.max("k")).first()[0] or 0, size)
    part = max(1, size // FINER)
    every = cells.select(*by, F.col("k").cast("long").alias("k"), F.col("value").cast("double").alias("value")).unionByName(ends)
    ranked = numbered(every.filter("value is not null"), by, ["value", "k"], "r", 4 * size)
    full = ranked.select(*by, "k", "value", "r").unionByName(every.filter("value is null").withColumn("r", F.lit(None).cast("long")))
    full = full.select(*by, "k", "value", F.floor(F.col("k") / size).alias("c"), F.floor(F.col("r") / part).alias("j")).checkpoint()

    # Per chunk and range: elements of the range before the chunk, its least and largest value.
    edges = full.filter("j is not null").groupBy(*by, "j").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    met = full.filter("j is not null").groupBy(*by, "j", "c").agg(F.count(F.lit(1)).alias("n"))
    last = full.groupBy(*by).agg(F.max("c").alias("last"))
    grid = edges.join(last, by).select(*by, "j", "low", "high", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("c"))
    earlier = Window.partitionBy(*by, "j").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    table = grid.join(met, [*by, "j", "c"], "left").withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    table = table.select(*[F.col(x).alias(x) for x in (*by, "j", "low", "high", "c", "before")]).checkpoint()  # columns of their own, for the grouping with cells

    def keyed(key, height: int, **columns) -> pd.DataFrame:
        return pd.DataFrame({**{c: pd.Series([k] * height, dtype=object) for c, k in zip(by, key, strict=False)}, **columns})

    def seek(key, pdf: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        k = pdf["k"].to_numpy(np.int64)
        if not len(t):
            return keyed(key, 0, c=[], k=[], n=[], j=[], place=[], value=[], mad=[])
        ranges = Ranges(pdf, t)
        some = ranges.n > 0
        if key[-1] == 0:  # nothing lies before the first chunk
            medians, mads = (x[:-1][some] for x in running(pdf["value"].to_numpy(float)))
            return keyed(key, len(mads), c=0, k=k[some], n=ranges.n[some], j=None, place=None, value=medians, mad=mads)
        out = []
        for place, asks in (((ranges.n - 1) // 2, some), (ranges.n // 2, some & (ranges.n % 2 == 0))):
            place = np.clip(place, 0, np.maximum(ranges.n - 1, 0))
            j = ranges.holding(place)
            out.append(pd.DataFrame({"k": k, "n": ranges.n, "j": j, "place": place - ranges.below(j), "value": np.where(ranges.one[j], ranges.low[j], np.nan)})[asks])
        got = pd.concat(out)
        return keyed(key, len(got), c=key[-1], **{x: got[x].to_numpy() for x in got}, mad=None)

    asked = full.groupBy(*by, "c").cogroup(table.groupBy(*by, "c")).applyInPandas(lambda key, a, b: seek(key, a, b), f"{key_sql}, c long, k long, n long, j long, place long, value double, mad double")
    asked = asked.withColumn("value", F.nanvl("value", F.lit(None))).checkpoint()

    def dealt(need: DataFrame, on: list[str]) -> DataFrame:
        """The elements before a chunk's end of the ranges ``j`` that it needs."""
        elements = full.filter("j is not null").select(*by, "j", F.col("c").alias("own"), F.col("k").alias("at"), F.col("value").alias("element"))
        both = elements.join(need, [*by, "j"]).filter("own <= c")
        return both.select(*[F.col(x).alias(x) for x in (*by, *on)], F.col("at").alias("k"), F.col("element").alias("value"))  # columns of their own, for the grouping with those who ask

    def look(key, q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        e = e.sort_values("k")
        own = Prefixes(e["value"].to_numpy(float))
        at = np.searchsorted(e["k"].to_numpy(np.int64), q["k"].to_numpy(np.int64), "left")
        return keyed(key, len(q), c=key[-2], k=q["k"].to_numpy(), n=q["n"].to_numpy(), value=own.value(at, q["place"].to_numpy(np.int64)))

    open_ = asked.filter("value is null").select(*by, "c", "j", "k", "n", "place")
    need = open_.select(*by, "c", "j").distinct()
    found = open_.groupBy(*by, "c", "j").cogroup(dealt(need, ["c", "j"]).groupBy(*by, "c", "j")).applyInPandas(lambda key, a, b: look(key, a, b), f"{key_sql}, c long, k long, n long, value double")
    found = found.unionByName(asked.filter("value is not null").select(*by, "c", "k", "n", "value"))
    middle = found.groupBy(*by, "c", "k").agg(F.max("n").alias("n"), F.min("value").alias("a"), F.max("value").alias("b"))
    middle = middle.select(*by, "c", "k", "n", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.col("a") + F.col("b")) / 2).alias("m")).checkpoint()

    names = ["l1", "l2", "r1", "r2"]

    def enclose(key, pdf: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        columns = ["c", "k", "m", "lower", "upper", "first", "last", *names]
        if not len(t):
            return keyed(key, 0, **{c: [] for c in columns})
        ranges = Ranges(pdf, t)
        rows = np.flatnonzero(ranges.n > 1)
        m, n = pdf["m"].to_numpy(float)[rows], ranges.n[rows]
        first, last = (n - 1) // 2, n // 2
        lower, upper, *ends, skip = ranges.kept(m, first, last, rows)
        return keyed(key, len(rows), c=key[-1], k=pdf["k"].to_numpy(np.int64)[rows], m=m, lower=lower, upper=upper, first=first - skip, last=last - skip, **dict(zip(names, ends, strict=True)))

    told = full.filter("c > 0").join(middle.filter("c > 0").select(*by, "k", "m"), [*by, "k"], "left").select(*by, "c", "k", "j", "m")
    wanted = told.groupBy(*by, "c").cogroup(table.filter("c > 0").groupBy(*by, "c")).applyInPandas(lambda key, a, b: enclose(key, a, b), f"{key_sql}, c long, k long, m double, lower double, upper double, first long, last long, " + ", ".join(f"{x} long" for x in names)).checkpoint()

    def measure(key, q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        e = e.sort_values("k")
        own = Prefixes(e["value"].to_numpy(float))
        at = np.searchsorted(e["k"].to_numpy(np.int64), q["k"].to_numpy(np.int64), "left")
        m, lower, upper = (q[x].to_numpy(float) for x in ("m", "lower", "upper"))

        def deviation(place: np.ndarray) -> np.ndarray:
            """What lies at a bound isn't among the elements: places before them are at the lower one, places after them at the upper one."""
            out, inner = np.where(place < 0, lower, upper), (place >= 0) & (place < at)
            if inner.any():
                out[inner] = np.clip(own.deviations(at[inner], m[inner], place[inner])[0], lower[inner], upper[inner])
            return out

        first, last = q["first"].to_numpy(np.int64), q["last"].to_numpy(np.int64)
        one = deviation(first)
        return keyed(key, len(q), k=q["k"].to_numpy(), mad=np.where(first == last, one, (one + deviation(last)) / 2))

    span = lambda a, b: F.when(F.col(a) <= F.col(b), F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    unsure = wanted.filter("lower < upper")
    need = unsure.select(*by, "c", *names).distinct().withColumn("j", F.explode(F.concat(span("l1", "l2"), span("r1", "r2"))))
    mads = unsure.groupBy(*by, "c", *names).cogroup(dealt(need, ["c", *names]).groupBy(*by, "c", *names)).applyInPandas(lambda key, a, b: measure(key, a, b), f"{key_sql}, k long, mad double")
    mads = mads.unionByName(wanted.filter("lower >= upper").select(*by, "k", F.col("lower").alias("mad"))).unionByName(asked.filter("mad is not null").select(*by, "k", "mad"))
    out = full.select(*by, "k").join(middle.select(*by, "k", F.col("m").alias("median")), [*by, "k"], "left").join(mads, [*by, "k"], "left")
    return out.select(*by, "k", F.coalesce("median", F.lit(0.0)).alias("median"), F.coalesce("mad", F.lit(0.0)).alias("mad")).checkpoint()
