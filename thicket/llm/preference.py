"""Preference formatting: a prompt rendered once, and two masked completions.

The longest common prefix of the chosen and the rejected conversation, in whole turns,
is the prompt. What follows in each is a completion, in which only the assistant's
turns count for the loss. All of it is in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is rendered; the mask covers the text and the end mark.
HEAD, TAIL = "<|{role}|>\n", "<|end|>\n"


def _head(role: Column) -> Column:
    before, after = HEAD.split("{role}")
    return F.concat(F.lit(before), role, F.lit(after))


def common_turns(chosen: Column, rejected: Column) -> Column:
    """How many first turns of two arrays of (role, text) are the same."""
    differs = F.filter(
        F.zip_with(F.sequence(F.lit(1), F.greatest(F.size(chosen), F.size(rejected), F.lit(1))), F.arrays_zip(chosen.alias("c"), rejected.alias("r")), lambda i, p: F.when(~p["c"].eqNullSafe(p["r"]), i)),
        lambda i: i.isNotNull(),
    )
    shorter = F.least(F.size(chosen), F.size(rejected))
    return F.least(shorter, F.coalesce(F.try_element_at(differs, F.lit(1)) - 1, shorter))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t["role"]), t["text"], F.lit(TAIL))), "")


def masks(turns: Column) -> Column:
    """``start:end`` of the assistant's turns in the rendered text, in code points, joined by commas."""
    step = F.aggregate(
        turns,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(_head(t["role"])) + F.length(t["text"]) + F.lit(len(TAIL))).alias("at"),
            F.when(t["role"] == "assistant", F.array_append(a["spans"], F.concat_ws(":", a["at"] + F.length(_head(t["role"])), a["at"] + F.length(_head(t["role"])) + F.length(t["text"]) + F.lit(len(TAIL))))).otherwise(a["spans"]).alias("spans"),
        ),
    )
    return F.array_join(step["spans"], ",")


def conversations_of(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns (role, text) in order of turn, role and text.

    Null role or text: empty. Rows without a turn number come first, repeated ones stay.
    Rows without a conv_id can't be put together: each is a conversation of one turn, so
    however many there are, none is a long one. A conversation is one row here and in
    the result, so it must fit into one.
    """
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    each = turns.filter("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", role, text))).alias("t"))
    each = each.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    return each.unionByName(turns.filter("conv_id is null").select("conv_id", F.array(F.struct(role, text)).alias("turns")))


def formatted(pairs: DataFrame) -> DataFrame:
    """Format ``pair_id, chosen, rejected``, the latter two arrays of (role, text).

    Returns ``pair_id, prompt_turns, prompt, chosen, rejected, chosen_mask,
    rejected_mask``. Null arrays are empty, a null pair_id stays, other columns are
    ignored, long turns are whole, repeated rows give a row each and no rows none. Equal
    conversations have the whole as their prompt and empty completions; those that
    differ from the first turn have none.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    pairs = pairs.select("pair_id", F.coalesce("chosen", empty).alias("c"), F.coalesce("rejected", empty).alias("r"))
    pairs = pairs.withColumn("n", common_turns(F.col("c"), F.col("r")))
    rest = lambda x: F.slice(x, F.col("n") + 1, F.size(x))
    pairs = pairs.select("pair_id", "n", F.slice("c", 1, F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return pairs.select("pair_id", F.col("n").cast("long").alias("prompt_turns"), rendered(F.col("p")).alias("prompt"), rendered(F.col("c")).alias("chosen"), rendered(F.col("r")).alias("rejected"), masks(F.col("c")).alias("chosen_mask"), masks(F.col("r")).alias("rejected_mask"))


def swapped_pairs(turns: DataFrame) -> DataFrame:
    """Pairs from a table without ratings: each conversation is chosen over one that leaves it
    after some turns, one at least if it has two, and goes on as its neighbour does from
    there: ``conv_id`` with the lowest bit turned over. Without a neighbour it just ends."""
    c = conversations_of(turns)
    other = c.filter("conv_id is not null").select(F.expr("conv_id ^ 1").alias("of"), F.col("turns").alias("others"))
    n = F.size("turns")
    keep = F.when((n > 1) & F.col("conv_id").isNotNull(), 1 + F.pmod(F.shiftright("conv_id", 1), n - 1)).otherwise(0).cast("int")
    c = c.join(other, F.col("conv_id") == F.col("of"), "left").withColumn("keep", keep)
    own, rest = F.slice("turns", 1, F.col("keep")), F.slice("others", F.col("keep") + 1, F.size("others"))
    return c.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.when(F.col("others").isNull(), own).otherwise(F.concat(own, rest)).alias("rejected"))


#: DuckDB SQL for ``formatted(swapped_pairs(conversations))``.
SQL = """
with r as (select row_number() over () as rid, conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
u as (select *, case when conv_id is null then 'row ' || rid else 'id ' || conv_id end as key from r),
t as (select key, conv_id, role, text, row_number() over (partition by key order by turn nulls first, role, text) as k, count(*) over (partition by key) as n from u),
c as (select key, any_value(conv_id) as conv_id, any_value(n) as n from t group by key),
d as (select *, case when n > 1 and conv_id is not null then 1 + ((conv_id >> 1) % (n - 1) + n - 1) % (n - 1) else 0 end as keep from c),
x as (select t.key, k, role, text from t join d using (key) where k <= keep union all select d.key, t.k, t.role, t.text from d join t on t.conv_id = xor(d.conv_id, 1) where t.k > d.keep),
b as (select key, k, t.role as role, t.text as text, x.role as other_role, x.text as other from t full join x using (key, k)),
m as (select key, coalesce(min(case when role is distinct from other_role or text is distinct from other then k end) - 1, max(k)) as m from b group by key),
s as (select key, k, m, 'a' as side, role, text from t join m using (key) union all select key, k, m, 'b', role, text from x join m using (key)),
h as (select *, '<|' || role || '|>' || chr(10) as head, text || '<|end|>' || chr(10) as body from s),
p as (select *, coalesce(sum(case when k > m then length(head || body) end) over (partition by key, side order by k rows between unbounded preceding and 1 preceding), 0) + length(head) as first from h)
select conv_id as pair_id, cast(any_value(m) as bigint) as prompt_turns,
  coalesce(string_agg(head || body, '' order by k) filter (where side = 'a' and k <= m), '') as prompt,
  coalesce(string_agg(head || body, '' order by k) filter (where side = 'a' and k > m), '') as chosen,
  coalesce(string_agg(head || body, '' order by k) filter (where side = 'b' and k > m), '') as rejected,
  coalesce(string_agg(cast(cast(first as bigint) as varchar) || ':' || cast(cast(first + length(body) as bigint) as varchar), ',' order by k) filter (where side = 'a' and k > m and role = 'assistant'), '') as chosen_mask,
  coalesce(string_agg(cast(cast(first as bigint) as varchar) || ':' || cast(cast(first + length(body) as bigint) as varchar), ',' order by k) filter (where side = 'b' and k > m and role = 'assistant'), '') as rejected_mask
from c join p using (key) group by key, conv_id
"""
