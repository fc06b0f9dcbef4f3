"""Quality rules whose cutoffs come with a guarantee, in DataFrame functions only.

Each rule compares a statistic of the text with a cutoff from a grid. A path leads from
no cutoff to the strictest of all rules, one cutoff of one rule a step; the labelled
documents of low quality choose its order, so that what catches most of them comes
first. The labelled good documents, which the path has not seen, then judge it: a step
may be taken if the exact binomial test rejects that all rules so far together reject
more good documents than the limit. Each stratum goes along the path until its first
step that fails. As that order is fixed beforehand, every step is tested at the whole
level of its stratum (fixed-sequence testing), and the level is divided by the strata
(Bonferroni): with the stated confidence no stratum's false rejections are above the
limit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm.shared import SPACE, attach, shared_table

#: The grids of the rules: a document fails a rule if the statistic is above its cutoff.
GRIDS = {
    "symbol_ratio": [0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.7, 1.0],
    "dup_line_ratio": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8],
    "repeat_ratio": [0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5],
    "mean_word_chars": [6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0],
}


def statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``doc_id``, the columns in ``keep``, and the counts of each whole text.

    Null text has no words and no lines. Words in 3-word windows are compared by
    their 64-bit hashes within the document.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", *(keep or []), text.alias("t"), F.array_remove(F.split(text, f"[{SPACE}]+"), "").alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    d = d.select(
        "doc_id", *(keep or []), F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), lines.alias("lines"), F.transform("w", lambda x: F.xxhash64(x)).alias("x"),
    )
    d = d.withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dup_lines", F.size("lines").cast("long") - F.size(F.array_distinct("lines"))).drop("lines")
    grams = F.when(
        F.size("x") >= 3,
        F.zip_with(F.zip_with(F.col("x"), F.slice("x", 2, F.size("x")), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b))), F.slice("x", 3, F.size("x")), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b))),
    )
    d = d.withColumn("g", F.slice(grams, 1, F.greatest(F.size("x") - 2, F.lit(1)))).drop("x")
    # Sorted with their places, equal windows lie side by side.
    d = d.withColumn("sorted", F.array_sort(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).drop("g")
    alike = F.zip_with(F.slice("sorted", 1, F.size("sorted") - 1), F.slice("sorted", 2, F.size("sorted") - 1), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)))
    d = d.withColumn("found", F.when(F.size("sorted") >= 2, F.array_sort(F.array_distinct(F.flatten(F.filter(alike, lambda x: x.isNotNull())))))).drop("sorted")
    covered = F.when(
        F.size("found") > 0,
        F.aggregate(F.zip_with(F.col("found"), F.slice("found", 2, F.size("found")), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0).cast("long"), lambda s, x: s + x),
    ).otherwise(0)
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("found")


def log_gamma(x: Column) -> Column:
    """ln gamma(x), x > 0, by Stirling's series at x + 8; right to about 13 digits."""
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    y = x + 8
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - F.ln(product)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p); 1 where k is at or above the mean, where no test can pass."""
    k, n = k.cast("double"), n.cast("double")
    top = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    ratio = (1 - p) / p
    terms = F.aggregate(
        F.when(k >= 1, F.sequence(k.cast("long"), F.lit(1).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, i: F.struct((a.term * i * ratio / (n - i + 1)).alias("term"), (a.sum + a.term * i * ratio / (n - i + 1)).alias("sum")),
        lambda a: a.sum,
    )
    return F.when((n <= 0) | (k >= n * p), F.lit(1.0)).otherwise(F.least(top * terms, F.lit(1.0)))


def rule_columns(d: DataFrame) -> DataFrame:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return d.withColumns({"symbol_ratio": per("n_symbols", "n_words"), "dup_line_ratio": per("n_dup_lines", "n_lines"), "repeat_ratio": per("n_repeat_words", "n_words"), "mean_word_chars": per("word_chars", "n_words")})


def path(poor: DataFrame) -> list[tuple[str, float]]:
    """All (rule, cutoff) steps, from loose to strict within each rule: those first that lead
    to the cutoff that catches most of ``poor`` beyond the one before it."""
    sums = poor.agg(*[F.coalesce(F.sum((F.col(r) > c).cast("long")), F.lit(0)).alias(f"{r}_{j}") for r, g in GRIDS.items() for j, c in enumerate(g)]).first()  # a number a step
    steps = []
    for i, (r, grid) in enumerate(GRIDS.items()):
        caught = [sums[f"{r}_{j}"] for j in range(len(grid))][::-1]
        more = [b - a for a, b in zip([0, *caught], caught, strict=False)]
        steps += [(-max(more[j:]), j, i, r, c) for j, c in enumerate(reversed(grid))]
    return [(r, c) for _, _, _, r, c in sorted(steps)]


def first_step(steps: list[tuple[str, float]]) -> Column:
    """The first step, from 1, that rejects a document; null if none does."""
    return F.least(*[F.when(F.col(r) > c, i + 1) for i, (r, c) in enumerate(steps)])


def furthest(good: DataFrame, steps: int, limit: float, error: float) -> DataFrame:
    """``stratum, taken``: how many steps each stratum may take.

    ``good`` has one row a good document: ``stratum``, and ``step``, the first one that
    rejects it or null. ``limit`` bounds the share of good documents that a stratum
    rejects, at confidence ``1 - error`` for all strata at once.
    """
    counts = good.groupBy("stratum", F.coalesce("step", F.lit(steps + 1)).alias("step")).agg(F.count(F.lit(1)).alias("k")).checkpoint()
    sizes = counts.groupBy("stratum").agg(F.sum("k").alias("n"), F.collect_list(F.struct("step", "k")).alias("at"))  # at most a pair a step
    strata = max(sizes.count(), 1)
    # Steps between those that reject a document add nothing: all of them pass or fail as the one before.
    each = sizes.select("stratum", "n", "at", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    rejected = F.aggregate("at", F.lit(0).cast("long"), lambda a, x: a + F.when(x["step"] <= F.col("step"), x["k"]).otherwise(0))
    each = each.select("stratum", "n", "step", rejected.alias("k")).checkpoint()
    safe = binomial_tail(F.col("k"), F.col("n"), limit) <= F.lit(error / strata)
    return each.groupBy("stratum").agg((F.coalesce(F.min(F.when(~safe, F.col("step"))), F.lit(steps + 1)) - 1).alias("taken")).checkpoint()


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", limit: float = 0.02, error: float = 0.05, scope: str = "") -> DataFrame:
    """Score all documents and keep those that pass.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept`` and the stratum. ``base_failed`` is a fixed rule: fewer than 50
    words, or more than half of them in repeated 3-word windows. Others are kept unless
    a step that their stratum takes rejects them. The guarantee holds for good documents
    that pass the fixed rule. A stratum needs ``ln(error / strata) / ln(1 - limit)`` good
    labels (217 for four strata) to prove anything; with fewer it rejects nothing more.

    A document is good if all its labels have quality 1 and none is toxic, and of low
    quality if any label has a quality below 1. Null labels don't count. Rows that
    repeat a doc_id are judged each, and are one labelled document. Null text: no words.
    Very long texts are read whole. Null stratum: a stratum of its own. Null doc_id: has
    no label. Empty labels: only the fixed rule. An empty table gives an empty result.
    """
    stats = shared_table(rule_columns(statistics(docs, [stratum] if stratum != "doc_id" else [])), "rules", scope)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    marks = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.min("quality").alias("q"), F.max("toxic").alias("x"))
    known = stats.filter(~failed).join(marks, F.col("doc_id") == F.col("labelled")).withColumn("stratum", F.col(stratum))
    steps = path(known.filter("q < 1"))
    good = known.filter("q >= 1 and coalesce(x, 0) = 0").groupBy("doc_id", "stratum").agg(F.min(first_step(steps)).alias("step"))
    out = attach(stats, furthest(good, len(steps), limit, error), F.col(stratum).eqNullSafe(F.col("stratum")), "left")
    above = F.coalesce(first_step(steps) <= F.col("taken"), F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~above).alias("kept"), F.col(stratum).alias("stratum_value"))


def sql(limit: float = 0.02, error: float = 0.05) -> str:
    """DuckDB SQL for ``judge(documents, labels)``."""
    grid = ", ".join(f"({i}, '{r}', {j}, {c!r}::double)" for i, (r, g) in enumerate(GRIDS.items()) for j, c in enumerate(reversed(g)))
    space = SPACE
    return f"""
with d as (select row_number() over () as rid, doc_id, lang, coalesce(text, '') as t from documents),
w as (select rid, unnest(ws) as w, generate_subscripts(ws, 1) as i from (select rid, regexp_extract_all(t, '[^{space}]+') as ws from d)),
g as (select rid, i, w || ' ' || lead(w, 1) over o || ' ' || lead(w, 2) over o as gram from w window o as (partition by rid order by i)),
f as (select rid, i from (select rid, i, count(*) over (partition by rid, gram) as c from g where gram is not null) where c > 1),
r as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from f) group by rid),
s as (select d.rid, doc_id, lang, len(regexp_extract_all(t, '[^{space}]+')) as n_words, length(regexp_replace(t, '[{space}]+', '', 'g')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{space}]')) as ls, coalesce(r.n, 0) as n_repeat_words from d left join r using (rid)),
st as (select *, len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s),
v as (select *, case when n_words > 0 then n_symbols / n_words::double else 0 end as symbol_ratio, case when n_lines > 0 then n_dup_lines / n_lines::double else 0 end as dup_line_ratio,
  case when n_words > 0 then n_repeat_words / n_words::double else 0 end as repeat_ratio, case when n_words > 0 then word_chars / n_words::double else 0 end as mean_word_chars from st),
m as (select doc_id, min(quality) as q, max(toxic) as x from labels where doc_id is not null group by doc_id),
grid(i, rule, j, cut) as (values {grid}),
u as (select rid, unnest(['symbol_ratio', 'dup_line_ratio', 'repeat_ratio', 'mean_word_chars']) as rule, unnest([symbol_ratio, dup_line_ratio, repeat_ratio, mean_word_chars]) as x from v),
b as (select i, rule, j, cut, (select count(*) from u join v using (rid) join m using (doc_id) where not base_failed and m.q < 1 and u.rule = grid.rule and u.x > grid.cut) as caught from grid),
e as (select *, caught - coalesce(lag(caught) over (partition by rule order by j), 0) as more from b),
k as (select *, max(more) over (partition by rule order by j rows between current row and unbounded following) as key from e),
p as (select rule, cut, row_number() over (order by key desc, j, i) as step from k),
h as (select u.rid, min(step) as step from u join p on u.rule = p.rule and u.x > p.cut group by u.rid),
gd as (select doc_id, lang, min(h.step) as step from v join m using (doc_id) left join h using (rid) where not base_failed and m.q >= 1 and coalesce(m.x, 0) = 0 group by doc_id, lang),
n as (select lang, count(*) as n from gd group by lang),
c as (select n.lang, n.n, p.step, (select count(*) from gd where gd.lang is not distinct from n.lang and gd.step <= p.step) as k from n, p),
z as (select lang, step, case when k >= n * {limit} then 1 else list_sum(list_transform(range(0, k + 1), lambda a: exp(lgamma(n + 1) - lgamma(a + 1) - lgamma(n - a + 1) + a * ln({limit}) + (n - a) * ln(1 - {limit})))) end as tail from c),
y as (select lang, coalesce(min(case when tail > {error}::double / (select count(*) from n) then step end), {1 + sum(map(len, GRIDS.values()))}) - 1 as taken from z group by lang)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and not coalesce(h.step <= y.taken, false) as kept, v.lang as stratum_value
from v left join h using (rid) left join y on v.lang is not distinct from y.lang
"""
