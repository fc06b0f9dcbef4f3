"""One query for each operator over the test tables, and the SQL that checks it.

The matrices: ``lineitem`` (a line is a sample; quantity, price, discount and tax are its
features; zeros are missing) and customers with three features, some cells missing.
Customers by nation are the nodes of the split scans, and of a forest for routing and
forest analytics: a tree for each nation, grown over all its customers.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions.numeric import DropMode, drop
from thicket.operators import analytics, boost, forest, predict, sampling, scan, stats
from thicket.operators import density as density_
from thicket.operators import matrix as mx
from thicket.plans.parameters import Parameters, auto_parameters, density, parse
from thicket.sources import text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: An id for each line, as SQL: the table has lines that share order and number.
LINE_ID = "((l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey) * 1013 + l_suppkey"
FEATURES = ["quantity", "extendedprice", "discount", "tax"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r4(c: Column | str, digits: int = 4) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Results that sum floats are multiplied by this before rounding, so that none lies between two steps.
UNEVEN = 0.7390851332

# Inputs ------------------------------------------------------------------------------


def lines(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select(F.expr(LINE_ID).alias("sample_id"), *[F.col(f"l_{f}").alias(f) for f in FEATURES])
    return mx.from_wide(t, "sample_id", FEATURES)


M = "m as (select sample_id, feature, value from (select ((l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey) * 1013 + l_suppkey as sample_id, unnest(['quantity','extendedprice','discount','tax']) as feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) as value from lineitem))"
C = M + ", c as (select * from m where value <> 0)"


def flagged(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select("l_returnflag", *[drop(F.col(f"l_{f}"), DropMode.ZEROS).alias(f) for f in FEATURES])
    return t.unpivot(["l_returnflag"], FEATURES, "feature", "value")


G = "g as (select * from (select l_returnflag, unnest(['quantity','extendedprice','discount','tax']) as feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) as value from lineitem) where value <> 0)"


#: Features of customers: column, every how manieth is missing, and its value as SQL.
CUSTOMER = [("a", 11, "c_acctbal"), ("b", 13, "((c_custkey * 7919) % 1009) / 8.0 - 60"), ("c", 17, "((c_custkey * 4657 + c_nationkey * 31) % 757) / 4.0 + 5")]
OUTPUTS = [c for c, _, _ in CUSTOMER]


def nations(spark: SparkSession, d: str) -> DataFrame:
    """Customers by nation: node, sample and features, some cells missing."""
    t = table(spark, d, "customer")
    cells = [F.when(F.col("c_custkey") % lost != 0, F.expr(f"cast({value} as double)")).alias(name) for name, lost, value in CUSTOMER]
    return t.select(F.col("c_nationkey").alias("node"), F.col("c_custkey").alias("sample_id"), *cells).unpivot(["node", "sample_id"], OUTPUTS, "feature", "value")


NM = f"""nm as materialized (select node, sample_id, feature, value from (select c_nationkey as node, c_custkey as sample_id, unnest({OUTPUTS}) as feature,
  unnest([{", ".join(f"case when c_custkey % {lost} <> 0 then cast({value} as double) end" for _, lost, value in CUSTOMER)}]) as value from customer)),
dr as (select node, feature as split_feature, sample_id, value as split_value, row_number() over (partition by node, feature order by value, sample_id) - 1 as k,
  count(*) over (partition by node, feature) as n from nm where value is not null),
al as (select dr.*, nm.feature, nm.value from dr join nm using (node, sample_id) where n >= 6)"""
ORDERED = "over (partition by node, split_feature, feature order by k rows between unbounded preceding and 1 preceding)"
ONWARD = "over (partition by node, split_feature, feature order by k rows between current row and unbounded following)"
NMS = NM + f""", sc as (select *, coalesce(case when count(value) {ORDERED} < 2 then 0 else mad(value) {ORDERED} end, 0) as mb, coalesce(case when count(value) {ONWARD} < 2 then 0 else mad(value) {ONWARD} end, 0) as mo,
  coalesce(median(value) {ONWARD}, 0) as med, coalesce(var_pop(value) {ORDERED}, 0) as vb, coalesce(var_pop(value) {ONWARD}, 0) as vo from al)"""


def score_sql(before: str, onward: str, norm: str) -> str:
    d = f"({onward} * (n + 1 - k) / (n + 1.0) + {before} * (k + 1) / (n + 1.0))"
    return f"ss as (select node, split_feature, k, n, any_value(split_value) as split_value, sum(case when feature <> split_feature then {d if norm == 'l1' else d + ' * ' + d} else 0 end) / sum(case when feature <> split_feature then 1 else 0 end) as score from sc group by node, split_feature, k, n)"


def along(spark: SparkSession, d: str) -> DataFrame:
    m = nations(spark, d)
    return scan.drawn(m, m)


#: Of the forest over nations: nodes of more samples are split, down to a depth.
LEAF, DEPTH = 5, 2
_forests: dict[tuple[str, str], tuple[list[tuple], DataFrame]] = {}


def trees(spark: SparkSession, d: str) -> DataFrame:
    """A tree for each nation, over all its customers; grown once for a session and folder, and again when the folder's customers have changed."""
    key, now = (spark.sparkContext.applicationId, d), versions(table(spark, d, "customer"))
    if key not in _forests or _forests[key][0] != now:
        _forests[key] = now, grown(spark, d)
    return _forests[key][1]


def versions(df: DataFrame) -> list[tuple]:
    """The files that a table is read from, with lengths and times."""
    spark, out = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return out


def grown(spark: SparkSession, d: str) -> DataFrame:
    return forest.fit_levels(nations(spark, d).withColumn("tree_id", (F.col("node") + 1).cast("int")), LEAF, DEPTH)


def customers(spark: SparkSession, d: str) -> DataFrame:
    return nations(spark, d).drop("node")


def level_sql(k: int) -> str:
    """The scan of all nodes of a level, their best splits, and the next level's cells."""
    at = "over (partition by tree_id, node_id, split_feature, feature order by k rows between "
    before, onward = at + "unbounded preceding and 1 preceding)", at + "current row and unbounded following)"
    return f"""sz{k} as (select tree_id, node_id, count(distinct sample_id) as samples from c{k} group by all),
dr{k} as materialized (select tree_id, node_id, feature as split_feature, sample_id, value as split_value, row_number() over (partition by tree_id, node_id, feature order by value, sample_id) - 1 as k, count(*) over (partition by tree_id, node_id, feature) as n
  from c{k} join sz{k} using (tree_id, node_id) where value is not null and samples > {LEAF}),
al{k} as (select dr{k}.*, c{k}.feature, c{k}.value from dr{k} join c{k} using (tree_id, node_id, sample_id) where n >= 6),
sc{k} as (select *, coalesce(case when count(value) {before} < 2 then 0 else mad(value) {before} end, 0) as mb, coalesce(case when count(value) {onward} < 2 then 0 else mad(value) {onward} end, 0) as mo from al{k}),
ss{k} as (select tree_id, node_id, split_feature, k, n, any_value(split_value) as split_value, sum(case when feature <> split_feature then (mo * (n + 1 - k) / (n + 1.0) + mb * (k + 1) / (n + 1.0)) else 0 end) / sum(case when feature <> split_feature then 1 else 0 end) as score from sc{k} group by tree_id, node_id, split_feature, k, n),
bc{k} as (select tree_id, node_id, split_feature, arg_min({{k: k, v: split_value, n: n, s: score}}, {{s: score, k: -k}}) as b from ss{k} where k between 3 and n - 3 group by 1, 2, 3),
ct{k} as (select tree_id, node_id, split_feature, b.k as k, b.v as split_value, b.s * (samples - b.n + 1) as score from bc{k} join sz{k} using (tree_id, node_id)),
bs{k} as materialized (select tree_id, node_id, arg_min({{f: split_feature, k: k, v: split_value}}, {{s: score, f: split_feature}}) as b from ct{k} group by 1, 2),
c{k + 1} as materialized (select c{k}.tree_id, c{k}.node_id || case when dr{k}.k < b.k then 'L' else 'R' end as node_id, c{k}.sample_id, c{k}.feature, c{k}.value
  from bs{k} join dr{k} on dr{k}.tree_id = bs{k}.tree_id and dr{k}.node_id = bs{k}.node_id and dr{k}.split_feature = b.f join c{k} on c{k}.tree_id = dr{k}.tree_id and c{k}.node_id = dr{k}.node_id and c{k}.sample_id = dr{k}.sample_id)"""


#: The forest over nations in SQL: nodes ``n0``, their outputs ``lf``.
N = f"""{NM}, c0 as (select node + 1 as tree_id, 'RT' as node_id, sample_id, feature, value from nm), {", ".join(map(level_sql, range(DEPTH)))},
cs as materialized ({" union all ".join(f"select * from c{k}" for k in range(DEPTH + 1))}),
cut as ({" union all ".join(f"select * from bs{k}" for k in range(DEPTH))}),
n0 as materialized (select tree_id, node_id, case when len(node_id) > 2 then node_id[:-2] end as parent_id, len(node_id) - 2 as depth, case when len(node_id) > 2 then node_id[-1] end as side, b.f as split_feature, b.v as split_value, samples
  from (select tree_id, node_id, list(distinct cast(sample_id as varchar)) as samples from cs group by all) left join cut using (tree_id, node_id)),
lf0 as (select tree_id, node_id, parent_id, depth, split_feature is null as is_leaf, feature, coalesce(median(value), 0) as median, coalesce(case when count(value) < 2 then 0 else mad(value) end, 0) as dispersion from cs join n0 using (tree_id, node_id) group by all),
lf1 as (select *, case when median <> 0 then dispersion / median else 0 end as cov from lf0),
lf as materialized (select a.*, b.cov - a.cov as local_gain, case when a.parent_id is not null then r.cov - a.cov end as absolute_gain from lf1 a left join lf1 b on a.tree_id = b.tree_id and a.parent_id = b.node_id and a.feature = b.feature
  join lf1 r on r.tree_id = a.tree_id and r.node_id = 'RT' and r.feature = a.feature)"""


def route_sql(policy: str) -> str:
    """Each sample's path through a tree in one pass over wide rows: a list of the nodes that it ends in."""
    left, right = "x <= t.v", "x > t.v"
    if policy == "branch":
        left, right = "x is null or x <= t.v", "x is null or x > t.v"
    stop = "t.f is null" + (" or x is null" if policy == "truncate" else "")
    step = lambda k: f"w{k + 1} as (select sample_id, a, b, c, tree_id, node_id || side as node_id from x{k} t, (values ('L'), ('R')) s(side) where t.f is not null and case when side = 'L' then {left} else {right} end)"
    look = lambda k: f"x{k} as materialized (select w.*, n0.split_feature as f, n0.split_value as v, case n0.split_feature when 'a' then a when 'b' then b when 'c' then c end as x from w{k} w join n0 using (tree_id, node_id))"
    wide = "w0 as (select sample_id, a, b, c, tree_id, 'RT' as node_id from (select sample_id, max(value) filter (where feature = 'a') as a, max(value) filter (where feature = 'b') as b, max(value) filter (where feature = 'c') as c from nm group by sample_id), (select distinct tree_id from n0))"
    levels = ", ".join(x for k in range(DEPTH) for x in (look(k), step(k)))
    return f"{N}, {wide}, {levels}, {look(DEPTH)}, rt as materialized ({' union all '.join(f'select sample_id, tree_id, node_id from x{k} t where {stop}' for k in range(DEPTH + 1))})"


def routed(spark: SparkSession, d: str, policy: str) -> DataFrame:
    m = customers(spark, d)
    return predict.route(trees(spark, d), predict._with_all_samples(predict.present(m, DropMode.NO), m), policy)


# Matrix and statistics ---------------------------------------------------------------


@query(f"with {M} select sample_id, feature, value from m")
def matrix_unpivot(spark, d):
    return lines(spark, d)


@query(f"with {M} select feature as sample_id, cast(sample_id as varchar) as feature, value from m")
def matrix_transpose(spark, d):
    return mx.transpose(lines(spark, d))


@query(f"select {LINE_ID} as sample_id, l_quantity as quantity, l_extendedprice as extendedprice, l_discount as discount, l_tax as tax from lineitem")
def matrix_pivot(spark, d):
    return mx.to_wide(lines(spark, d), FEATURES)


@query(f"with {M} select sample_id, feature, value from m where value <> 0")
def sanitize_drop_zeros(spark, d):
    return mx.dropped(lines(spark, d), DropMode.ZEROS)


@query("select event_id as sample_id, case when event_id % 5 = 0 then 'nan' when event_id % 7 = 0 then 'inf' else 'value' end as feature, case when event_id % 5 = 0 or event_id % 7 = 0 then 0.0 else value end as value from events")
def sanitize_odd_floats(spark, d):
    e = table(spark, d, "events")
    v = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    kind = F.when(F.col("event_id") % 5 == 0, "nan").when(F.col("event_id") % 7 == 0, "inf").otherwise("value")
    return e.select(F.col("event_id").alias("sample_id"), kind.alias("feature"), drop(v, DropMode.NO).alias("value"))


@query("select event_id as sample_id, value from events where event_id % 5 <> 0")
def drop_nans(spark, d):
    v = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    e = table(spark, d, "events").select(F.col("event_id").alias("sample_id"), F.lit("v").alias("feature"), v.alias("value"))
    return mx.dropped(e, DropMode.NANS).select("sample_id", "value")


@query(f"with {M} select sample_id, feature, value from m where feature in ('tax', 'discount') and sample_id in (select {LINE_ID} from lineitem semi join orders on o_orderkey = l_orderkey and o_orderstatus = 'F')")
def subset_by_name(spark, d):
    own = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    s = table(spark, d, "lineitem").join(own, "l_orderkey", "left_semi").select(F.expr(LINE_ID).alias("sample_id"))
    return mx.subset(lines(spark, d), s, ["tax", "discount"])


@query(f"with {M} select value from m where feature = 'tax' and sample_id = (select min({LINE_ID}) from lineitem)")
def fetch_cell(spark, d):
    first = table(spark, d, "lineitem").agg(F.min(F.expr(LINE_ID))).first()[0]
    return mx.cell(lines(spark, d), "tax", first)


@query(f"with {NM} select sample_id, feature, x - x * 0.5 as difference, x * (x * 0.5) as product, x + x * 0.5 as total from (select sample_id, feature, coalesce(value, 0) as x from nm)")
def matrix_arithmetic(spark, d):
    a = customers(spark, d)
    got = mx.combined(a, a.withColumn("value", F.col("value") * 0.5), ["subtract", "multiply", "add"])
    return got.select("sample_id", "feature", F.col("subtract").alias("difference"), F.col("multiply").alias("product"), F.col("add").alias("total"))


@query("select c_custkey as sample_id, abs(c_acctbal) as magnitude, round(c_acctbal * c_acctbal, 2) as square from customer")
def matrix_abs_square(spark, d):
    m = mx.from_wide(table(spark, d, "customer"), "c_custkey", ["c_acctbal"])
    return mx.absolute(m).select("sample_id", F.col("value").alias("magnitude")).join(mx.squared(m).select("sample_id", r4("value", 2).alias("square")), "sample_id")


@query(f"with {C} select feature, count(*) as n, median(value) as median from c group by feature")
def median_by_feature(spark, d):
    return stats.summary(mx.dropped(lines(spark, d), DropMode.ZEROS)).select("feature", "n", "median")


@query(f"with {C}, a as (select feature, median(value) as m from c group by feature) select c.feature, count(*) as n, any_value(m) as median, round(median(abs(value - m)), 6) as mad from c join a using (feature) group by c.feature")
def medians_by_selection(spark, d):
    """As if a task could hold a thousand values."""
    return stats.summary(mx.dropped(lines(spark, d), DropMode.ZEROS), ["feature"], 1000).select("feature", "n", "median", r4("mad", 6).alias("mad"))


GROUPS = f"with {G}, a as (select l_returnflag, feature, median(value) as m from g group by all)"


@query(f"{GROUPS} select g.l_returnflag, g.feature, count(*) as n, any_value(m) as median, round(median(abs(value - m)), 6) as mad from g join a using (l_returnflag, feature) group by g.l_returnflag, g.feature")
def mad_by_group(spark, d):
    return stats.summary(flagged(spark, d), ["l_returnflag", "feature"]).select("l_returnflag", "feature", "n", "median", r4("mad", 6).alias("mad"))


@query(f"{GROUPS} select g.l_returnflag, g.feature, cast(var_pop(value) as float) as var_pop, cast(var_samp(value) as float) as var_samp, cast(avg(value) as float) as mean, cast(sum((value - m) * (value - m)) as float) as l2, round(case when count(*) < 2 then 0 else mad(value) end / any_value(m), 6) as cov from g join a using (l_returnflag, feature) group by g.l_returnflag, g.feature")
def dispersion_by_group(spark, d):
    s = stats.summary(flagged(spark, d), ["l_returnflag", "feature"])
    return s.select("l_returnflag", "feature", *[F.col(c).cast("float").alias(c) for c in ("var_pop", "var_samp", "mean", "l2")], r4("cov", 6).alias("cov"))


@query("with e as (select vec_id, f, embedding[f + 1]::double as v from embeddings, range(64) t(f)) select 'e' || a.f as f1, 'e' || b.f as f2, count(*) as n, round(corr(a.v, b.v), 6) as r, round(covar_samp(a.v, b.v), 6) as covariance from e a join e b using (vec_id) group by all")
def pearson_pairs(spark, d):
    return stats.correlations(vectors(spark, d)).select("f1", "f2", "n", r4("r", 6).alias("r"), r4("covariance", 6).alias("covariance"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """All components of the vectors; the longest says how many there are."""
    e = table(spark, d, "embeddings")
    width = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    return mx.from_wide(e.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(width)]), "vec_id", [f"e{i}" for i in range(width)])


@query("select round(avg((l_quantity - l_quantity * 1.1) * (l_quantity - l_quantity * 1.1)), 6) as mse, round(avg(abs(l_quantity * 0.1)), 6) as mae, round(corr(l_quantity, l_quantity * 1.1), 6) as r, count(*) as n from lineitem")
def error_metrics(spark, d):
    m = mx.subset(lines(spark, d), None, ["quantity"])
    return stats.errors(m, m.withColumn("value", F.col("value") * 1.1)).select(r4("mse", 6).alias("mse"), r4("mae", 6).alias("mae"), r4("r", 6).alias("r"), "n")


@query(f"with {C} select sample_id, feature, round(value - coalesce(avg(value) over (partition by feature), 0), 2) as error from c")
def residual_matrix(spark, d):
    m = mx.dropped(lines(spark, d), DropMode.ZEROS)
    guess = m.join(F.broadcast(m.groupBy("feature").agg(F.avg("value").alias("a"))), "feature").select("sample_id", "feature", F.col("a").alias("value"))
    return boost.residuals(m, guess).select("sample_id", "feature", r4("value", 2).alias("error"))


# Split scans --------------------------------------------------------------------------


@query(f"with {NM} select node, split_feature, sample_id, split_value, k, n from dr")
def draw_order(spark, d):
    return scan.draw_order(nations(spark, d)).select("node", "split_feature", "sample_id", "split_value", F.col("k").cast("long"), "n")


@query(f"with {NMS} select node, split_feature, feature, k, round(vb * {UNEVEN}, 3) as before, round(vo * {UNEVEN}, 3) as onward from sc")
def variance_scan(spark, d):
    return scan.variance_scan(along(spark, d)).select("node", "split_feature", "feature", F.col("k").cast("long"), r4(F.col("before") * UNEVEN, 3).alias("before"), r4(F.col("onward") * UNEVEN, 3).alias("onward"))


@query(f"with {NMS} select node, split_feature, feature, k, round(med, 4) as median_onward, round(mb, 4) as mad_before, round(mo, 4) as mad_onward from sc")
def mad_scan(spark, d):
    out = scan.mad_scan(along(spark, d))
    n = scan.draw_order(nations(spark, d)).groupBy("node", "split_feature").agg(F.max("n").alias("n"))
    return out.join(n, ["node", "split_feature"]).filter("k < n").select("node", "split_feature", "feature", F.col("k").cast("long"), *[r4(c).alias(c) for c in ("median_onward", "mad_before", "mad_onward")])


@query(f"with {NMS}, w as (select *, case when med <> 0 then abs(mo / med) else 0 end as cov from sc) select node, split_feature, feature, k, round(greatest(first_value(mo) over w1 - mo, 0), 4) as mad_gain, round(cov, 4) as cov_onward from w window w1 as (partition by node, split_feature, feature order by k)")
def mad_gains(spark, d):
    n = scan.draw_order(nations(spark, d)).groupBy("node", "split_feature").agg(F.max("n").alias("n"))
    return scan.mad_gains(scan.mad_scan(along(spark, d))).join(n, ["node", "split_feature"]).filter("k < n").select("node", "split_feature", "feature", F.col("k").cast("long"), r4("mad_gain").alias("mad_gain"), r4("cov_onward").alias("cov_onward"))


def _scores(mode: str, norm: str):
    def f(spark, d):
        return scan.split_scores(along(spark, d), mode, norm).filter("k between 3 and n - 3").select("node", "split_feature", F.col("k").cast("long"), r4(F.col("score") * UNEVEN, 3).alias("score"))

    return f


for _mode, (_b, _o) in {"mad": ("mb", "mo"), "variance": ("vb", "vo")}.items():
    for _norm in ("l1", "l2"):
        if (_mode, _norm) == ("variance", "l2"):
            continue
        QUERIES[f"split_scores_{_mode}_{_norm}"] = _scores(_mode, _norm)
        SQL[f"split_scores_{_mode}_{_norm}"] = f"with {NMS}, {score_sql(_b, _o, _norm)} select node, split_feature, k, round(score * {UNEVEN}, 3) as score from ss where k between 3 and n - 3"

#: All customers as one node, in chunks and ranges of this size: the scans whose cells stay spread over tasks.
ROOT_SIZE = 500
ROOT_SQL = NMS.replace("select c_nationkey as node, c_custkey as sample_id", "select 0 as node, c_custkey as sample_id")


def whole_root(spark: SparkSession, d: str) -> DataFrame:
    return nations(spark, d).withColumn("node", F.lit(0))


@query(f"with {ROOT_SQL} select split_feature, feature, k, round(med, 4) as median_onward, round(mb, 4) as mad_before, round(mo, 4) as mad_onward from sc")
def root_mad_scan(spark, d):
    m = whole_root(spark, d)
    along = scan.drawn(m, m, True, ROOT_SIZE).checkpoint()
    n = along.select("split_feature", "n").distinct()
    return scan.mad_scan(along, True, ROOT_SIZE).join(n, "split_feature").filter("k < n").select("split_feature", "feature", F.col("k").cast("long"), *[r4(c).alias(c) for c in ("median_onward", "mad_before", "mad_onward")])


SIZES = "sz as (select c_nationkey as node, count(*) as samples from customer group by 1)"
CUTS = f"with {NMS}, {score_sql('mb', 'mo', 'l1')}, {SIZES}, bc as (select node, split_feature, arg_min({{k: k, v: split_value, n: n, s: score}}, {{s: score, k: -k}}) as b from ss where k between 3 and n - 3 group by 1, 2), ct as (select node, split_feature, b.k as k, b.v as split_value, b.s * (samples - b.n + 1) as score from bc join sz using (node))"


def cuts(spark, d, best="min"):
    m = nations(spark, d)
    sizes = m.filter("feature = 'a'").groupBy("node").agg(F.count(F.lit(1)).alias("samples"))
    return scan.best_cuts(scan.split_scores(along(spark, d)), sizes, best)


@query(f"{CUTS} select node, split_feature, k, split_value, round(score * {UNEVEN}, 2) as score from ct")
def best_cuts(spark, d):
    return cuts(spark, d).select("node", "split_feature", F.col("k").cast("long"), "split_value", r4(F.col("score") * UNEVEN, 2).alias("score"))


@query(f"with {NMS}, {score_sql('mb', 'mo', 'l1')}, bc as (select node, split_feature, arg_max({{k: k, n: n, s: score}}, {{s: score, k: -k}}) as b from ss where k between 3 and n - 3 group by 1, 2) select node, split_feature, b.k as k, round(b.s * b.n * {UNEVEN}, 2) as score from bc")
def best_cuts_max(spark, d):
    return cuts(spark, d, "max").select("node", "split_feature", F.col("k").cast("long"), r4(F.col("score") * UNEVEN, 2).alias("score"))


BEST = f"{CUTS}, bs as (select node, arg_min({{f: split_feature, k: k, v: split_value, s: score}}, {{s: score, f: split_feature}}) as b from ct group by node)"


@query(f"{BEST} select node, b.f as split_feature, b.k as k, b.v as split_value, round(b.s * {UNEVEN}, 2) as score from bs")
def best_split(spark, d):
    return scan.best_split(cuts(spark, d)).select("node", "split_feature", F.col("k").cast("long"), "split_value", r4(F.col("score") * UNEVEN, 2).alias("score"))


ROOT_BEST = BEST.replace(NMS, ROOT_SQL).replace("select c_nationkey as node, count(*) as samples", "select 0 as node, count(*) as samples")


@query(f"{ROOT_BEST} select b.f as split_feature, b.k as k, b.v as split_value, round(b.s * {UNEVEN}, 2) as score from bs")
def root_best_split(spark, d):
    m = whole_root(spark, d)
    scores = scan.split_scores(scan.drawn(m, m, True, ROOT_SIZE), wide=True, size=ROOT_SIZE)
    sizes = m.filter("feature = 'a'").groupBy("node").agg(F.count(F.lit(1)).alias("samples"))
    return scan.best_split(scan.best_cuts(scores, sizes)).select("split_feature", F.col("k").cast("long"), "split_value", r4(F.col("score") * UNEVEN, 2).alias("score"))


@query(f"{BEST} select bs.node, case when dr.k < b.k then 'L' else 'R' end as side, sample_id from bs join dr on dr.node = bs.node and dr.split_feature = b.f")
def split_children(spark, d):
    return scan.children(nations(spark, d), scan.best_split(cuts(spark, d)))


@query(f"{BEST} select bs.node, case when dr.split_value > b.v then 'R' else 'L' end as side, sample_id from bs join dr on dr.node = bs.node and dr.split_feature = b.f")
def split_routing(spark, d):
    return scan.route_by_value(nations(spark, d), scan.best_split(cuts(spark, d)))


# Routing and prediction ----------------------------------------------------------------


def _route(policy):
    return lambda spark, d: routed(spark, d, policy)


for _policy in ("branch", "truncate", "abort"):
    QUERIES[f"route_{_policy}"] = _route(_policy)
    SQL[f"route_{_policy}"] = f"with {route_sql(_policy)} select sample_id, tree_id, node_id from rt"


@query(f"with {route_sql('branch')} select sample_id, tree_id, node_id from rt")
def route_branch_joined(spark, d):
    m = customers(spark, d)
    return predict.route_joined(trees(spark, d), predict._with_all_samples(predict.present(m, DropMode.NO), m), "branch")


WEIGHTS = {
    "flat": "sum(median) / count(*)", "gain": "sum(median * greatest(absolute_gain, 0)) / nullif(sum(greatest(absolute_gain, 0)), 0)", "gain_squared": "sum(median * pow(greatest(absolute_gain, 0), 2)) / nullif(sum(pow(greatest(absolute_gain, 0), 2)), 0)",
    "dispersion": "case when min(cov) <= 0 then 0 else sum(median / nullif(cov, 0)) / sum(1 / nullif(cov, 0)) end", "dispersion_squared": "case when min(cov) <= 0 then 0 else sum(median / nullif(cov * cov, 0)) / sum(1 / nullif(cov * cov, 0)) end",
    "dispersion_squared_literal": "case when min(cov) <= 0 then 0 else sum(pow(median / nullif(cov * cov, 0), 2)) / sum(1 / nullif(cov * cov, 0)) end",
}


def _leaves(spark, d, policy="branch"):
    lf = forest.leaf_features(trees(spark, d)).select("tree_id", "node_id", "feature", "median", "dispersion", "cov", "absolute_gain")
    return routed(spark, d, policy).join(lf, ["tree_id", "node_id"])


def _average(weighing):
    literal = weighing.endswith("literal")
    return lambda spark, d: predict.combine(_leaves(spark, d), weighing.removesuffix("_literal"), literal).select("sample_id", "feature", (F.col("value").cast("float") if literal else r4(F.col("value") * UNEVEN, 3)).alias("value"))


for _name, _sql in WEIGHTS.items():
    QUERIES[f"leaf_average_{_name}"] = _average(_name)
    SQL[f"leaf_average_{_name}"] = f"with {route_sql('branch')} select sample_id, feature, {f'cast(coalesce({_sql}, 0) as float)' if _name.endswith('literal') else f'round(coalesce({_sql}, 0) * {UNEVEN}, 3)'} as value from rt join lf using (tree_id, node_id) group by sample_id, feature"

STACK = f"with {route_sql('branch')}, iv as (select sample_id, feature, median - dispersion as s, median + dispersion as e from rt join lf using (tree_id, node_id)), st as (select sample_id, feature, pos, sum(d) as d from (select sample_id, feature, s as pos, 1 as d from iv union all select sample_id, feature, e, -1 from iv) group by all), sg as (select sample_id, feature, pos as start, lead(pos) over w as end_, sum(d) over w as score from st window w as (partition by sample_id, feature order by pos))"


@query(f"{STACK} select sample_id, feature, start, end_ as \"end\", cast(score as double) as score from sg where end_ > start and score > 0")
def interval_stack(spark, d):
    return predict.interval_stack(predict.intervals(_leaves(spark, d)))


@query(f"{STACK} select sample_id, feature, arg_max((start + end_) / 2, {{s: score, a: start}}) as value from sg where end_ > start and score > 0 group by sample_id, feature")
def stacking_predict(spark, d):
    return predict.stacked(predict.interval_stack(predict.intervals(_leaves(spark, d))))


@query(f"with {route_sql('truncate')} select g.sample_id, g.feature, round(coalesce(v, 0) * {UNEVEN}, 3) as value from (select distinct nm.sample_id, x.feature from nm, (select distinct feature from lf) x) g left join (select sample_id, feature, sum(median * greatest(coalesce(absolute_gain, 0), 0)) / nullif(sum(greatest(coalesce(absolute_gain, 0), 0)), 0) as v from rt join lf using (tree_id, node_id) group by all) p using (sample_id, feature)")
def predict_truncate_gain(spark, d):
    return predict.predict(trees(spark, d), customers(spark, d), "truncate", mode=DropMode.NO).select("sample_id", "feature", r4(F.col("value") * UNEVEN, 3).alias("value"))


# Forest analytics ----------------------------------------------------------------------


@query(f"with {N} select tree_id, node_id, parent_id, depth, side, split_feature, split_value, split_feature is null as is_leaf, cast(len(samples) as bigint) as n_samples from n0")
def forest_levels(spark, d):
    return grown(spark, d).select("tree_id", "node_id", "parent_id", F.col("depth").cast("long"), "side", "split_feature", "split_value", "is_leaf", "n_samples")


@query(f"with {N} select nm.sample_id, nm.feature, nm.value, r.pos from (select sample_id, row_number() over (order by value nulls first, sample_id) as pos from nm where node = 0 and feature = (select split_feature from n0 where tree_id = 1 and node_id = 'RT')) r join nm using (sample_id)")
def node_cells(spark, d):
    return analytics.node_cells(trees(spark, d), customers(spark, d), 1, "RT").select("sample_id", "feature", "value", F.col("pos").cast("long"))


@query(f"with {N}, e as (select sample_id, feature, value from nm where node = 0 and value is not null and exists (select 1 from n0 where tree_id = 1 and node_id = 'RT' and split_feature is not null)) select y.feature, round(corr(x.value, y.value), 6) as r from e x join e y using (sample_id) where x.feature = 'a' group by 1")
def node_correlations(spark, d):
    cells = analytics.node_cells(trees(spark, d), customers(spark, d), 1, "RT").filter("value is not null")
    return analytics.node_correlations(cells, "a").select("feature", r4("r", 6).alias("r"))


@query(f"with {N} select tree_id, node_id, feature, round(local_gain, 6) as local_gain, round(absolute_gain, 6) as absolute_gain from lf")
def node_gains(spark, d):
    return forest.gains(trees(spark, d)).select("tree_id", "node_id", "feature", r4("local_gain", 6).alias("local_gain"), r4("absolute_gain", 6).alias("absolute_gain"))


@query(f"with {N} select tree_id, node_id, feature, round(cov, 6) as cov from lf")
def node_covs(spark, d):
    return analytics.covs(trees(spark, d)).select("tree_id", "node_id", "feature", r4("cov", 6).alias("cov"))


@query(f"with {N} select tree_id, node_id, unnest(samples) as sample_id from n0")
def membership_encoding(spark, d):
    return analytics.membership(trees(spark, d))


@query(f"with {N} select tree_id, node_id, feature, median from lf")
def median_matrix(spark, d):
    return analytics.median_matrix(trees(spark, d))


@query(f"with {N} select split_feature as feature, list_sort(list(depth + 1))::varchar as levels, count(*) as frequency, round(sum(5.0 / (depth + 1)), 6) as score from n0 where split_feature is not null group by 1")
def feature_levels(spark, d):
    return analytics.feature_levels(trees(spark, d)).select("feature", F.concat(F.lit("["), F.array_join("levels", ", "), F.lit("]")).alias("levels"), "frequency", r4("score", 6).alias("score"))


@query(f"with {N} select split_feature as feature, round(sum(5.0 / (depth + 1)), 6) as score from n0 where split_feature is not null group by 1 order by 2 desc, 1 limit 2")
def top_features(spark, d):
    return analytics.top(analytics.feature_levels(trees(spark, d)).select("feature", r4("score", 6).alias("score")), "score", 2)


@query(f"with {N} select p.split_feature, lf.feature, count(lf.local_gain) as n, round(avg(lf.local_gain), 6) as gain from lf join n0 p on p.tree_id = lf.tree_id and p.node_id = lf.parent_id group by all")
def gain_pairs(spark, d):
    return analytics.gain_pairs(trees(spark, d)).select("split_feature", "feature", "n", r4("gain", 6).alias("gain"))


@query(f"with {N} select p.split_feature, lf.feature, round(avg(lf.absolute_gain), 6) as gain from lf join n0 p on p.tree_id = lf.tree_id and p.node_id = lf.parent_id where is_leaf group by all having avg(lf.absolute_gain) > 0.1")
def strong_leaf_pairs(spark, d):
    return analytics.strong_pairs(analytics.gain_pairs(trees(spark, d), "absolute_gain"), 0.1).select("split_feature", "feature", r4("gain", 6).alias("gain"))


@query(f"with {N}, l as (select tree_id, feature, avg(cov) as c from lf where is_leaf group by all) select lf.tree_id, lf.feature, round(lf.cov, 6) as root_cov, round(l.c, 6) as leaf_cov, round(lf.cov - l.c, 6) as gain from lf join l using (tree_id, feature) where node_id = 'RT'")
def root_leaf_covs(spark, d):
    return analytics.root_leaf(trees(spark, d)).select("tree_id", "feature", *[r4(c, 6).alias(c) for c in ("root_cov", "leaf_cov", "gain")])


@query(f"with {N}, k as (select tree_id, split_feature as f, count(*) as n from n0 where split_feature is not null group by all), p as (select a.f as f1, b.f as f2, count(*) as trees, sum(a.n * b.n) as xy from k a join k b using (tree_id) group by all), s as (select f, sum(n) as s from k group by f) select f1, f2, trees, round((xy - a.s * b.s / t) / (t - 1), 6) as covariance from p join s a on a.f = f1 join s b on b.f = f2, (select count(distinct tree_id)::double as t from n0)")
def feature_cooccurrence(spark, d):
    return analytics.cooccurrence(trees(spark, d)).select("f1", "f2", "trees", r4("covariance", 6).alias("covariance"))


JD = f"with {N}, s as (select tree_id || '/' || node_id as node, samples from n0)"


@query(f"{JD} select a.node as a, b.node as b, round(1 - len(list_intersect(a.samples, b.samples)) / cast(len(list_distinct(list_concat(a.samples, b.samples))) as double), 6) as distance from s a join s b on a.node < b.node where len(list_intersect(a.samples, b.samples)) > 0")
def node_jaccard(spark, d):
    return analytics.jaccard_distances(trees(spark, d)).select("a", "b", r4("distance", 6).alias("distance"))


#: Nodes within the radius of each other, reached over any number of steps; a cluster has its least node's name.
CLUSTERS = f"""{JD.replace("with", "with recursive", 1)}, p as (select a.node as a, b.node as b from s a join s b on a.node < b.node where len(list_intersect(a.samples, b.samples)) > 0 and 1 - len(list_intersect(a.samples, b.samples)) / cast(len(list_distinct(list_concat(a.samples, b.samples))) as double) <= 0.5),
e as (select a, b from p union all select b, a from p), r(node, other) as (select a, b from e union select r.node, e.b from r join e on r.other = e.a), cl as (select s.node, min(other) as cluster from s left join r on s.node = r.node group by s.node)"""


@query(f"{CLUSTERS} select node, cluster from cl")
def node_clusters(spark, d):
    n = trees(spark, d)
    return analytics.clusters(analytics.jaccard_distances(n), n, 0.5, 2)


@query(f"""{CLUSTERS}, kd as (select n0.*, cluster from n0 join cl on cl.node = tree_id || '/' || node_id where cluster is not null), g as (select cluster, feature, avg(absolute_gain) as g from kd join lf using (tree_id, node_id) group by all),
t as (select cluster, string_agg(feature, ',' order by g desc nulls last, feature) as top_features from g group by 1), m as (select cluster, max(n) as most from (select cluster, tree_id, count(*) as n from kd group by all) group by 1)
select cluster, count(*) as nodes, count(distinct tree_id) as trees, any_value(top_features) as top_features, any_value(most) as most, nullif(sum(depth), 0)::bigint as requirements from kd join t using (cluster) join m using (cluster) group by cluster""")
def cluster_statistics(spark, d):
    n = trees(spark, d)
    labels = analytics.clusters(analytics.jaccard_distances(n), n, 0.5, 2)
    out = analytics.cluster_stats(n, labels).join(analytics.tree_histogram(n, labels).groupBy("cluster").agg(F.max("n").alias("most")), "cluster")
    out = out.join(analytics.requirement_frequency(n, labels).groupBy("cluster").agg(F.sum("n").alias("requirements")), "cluster", "left")
    return out.withColumn("top_features", F.array_join("top_features", ","))


@query()
def node_hdbscan(spark, d):
    n = trees(spark, d)
    points = n.select(F.concat_ws("/", "tree_id", "node_id").alias("node"))
    return density_.hdbscan(points, analytics.jaccard_distances(n), 3, 2)


@query(f"with {N}, l as (select tree_id, node_id, feature, coalesce(local_gain, 0) as g from lf where is_leaf) select a.tree_id, a.feature as f1, b.feature as f2, round(case when var_pop(a.g) <= 1e-12 * avg(a.g * a.g) or var_pop(b.g) <= 1e-12 * avg(b.g * b.g) then 0 else corr(a.g, b.g) end, 6) as corr from l a join l b using (tree_id, node_id) group by all")
def gain_correlation(spark, d):
    return boost.gain_correlation(trees(spark, d)).select("tree_id", "f1", "f2", r4("corr", 6).alias("corr"))


@query(f"with {N}, l as (select tree_id, node_id, feature, coalesce(local_gain, 0) as g from lf where is_leaf), k as (select a.tree_id, a.feature as f1, b.feature as f2, case when var_pop(a.g) <= 1e-12 * avg(a.g * a.g) or var_pop(b.g) <= 1e-12 * avg(b.g * b.g) then 0 else corr(a.g, b.g) end as corr from l a join l b using (tree_id, node_id) group by all) select f1, f2, round(avg(corr), 6) as corr from k group by all")
def similarity_mean(spark, d):
    return boost.similarity(trees(spark, d)).select("f1", "f2", r4("corr", 6).alias("corr"))


UP = f"with {N}, e as (select c.tree_id, c.node_id, p.split_feature || case when c.side = 'L' then '<' else '>' end || cast(p.split_value as varchar) as req, c.parent_id from n0 c join n0 p on p.tree_id = c.tree_id and p.node_id = c.parent_id), u as (select tree_id, node_id, req from e union all select a.tree_id, a.node_id, b.req from e a join e b on a.tree_id = b.tree_id and a.parent_id = b.node_id)"


@query(f"{UP} select n0.tree_id, n0.node_id, coalesce(string_agg(req, ';' order by req), '') as path from n0 left join u using (tree_id, node_id) group by all")
def node_requirements(spark, d):
    return analytics.requirement_paths(trees(spark, d))


@query(f"with {N} select tree_id, node_id from n0 where depth = 1 or split_feature is null and depth < 1")
def leaves_at_depth(spark, d):
    return analytics.leaves_at(analytics.to_depth(trees(spark, d), 1), 1).select("tree_id", "node_id")


@query(f"with {N} select tree_id, node_id from n0 a where split_feature is not null and not exists (select 1 from n0 b where b.tree_id = a.tree_id and b.parent_id = a.node_id and b.split_feature is not null)")
def nodes_above_leaves(spark, d):
    return analytics.above_leaves(trees(spark, d)).select("tree_id", "node_id")


@query(f"with {N} select tree_id, node_id, round(max(case when feature = 'a' then absolute_gain end), 6) as a, round(max(case when feature = 'b' then absolute_gain end), 6) as b, round(max(case when feature = 'c' then absolute_gain end), 6) as c from lf group by all")
def gain_vectors(spark, d):
    return analytics.gain_vectors(trees(spark, d), OUTPUTS).select("tree_id", "node_id", *[r4(c, 6).alias(c) for c in OUTPUTS])


@query("select case when l_quantity < 5 then 0 when l_quantity >= 45 then 9 else 1 + cast(floor((l_quantity - 5) / 5) as bigint) end as bin, count(*) as n from lineitem group by 1")
def value_histogram(spark, d):
    return analytics.histogram(mx.subset(lines(spark, d), None, ["quantity"]), "value", 5, 45, 8)


@query(f"with {N} select feature, dispersion from lf where is_leaf")
def leaf_dispersions(spark, d):
    return analytics.dispersion_values(trees(spark, d))


@query(f"with {N} select tree_id || ':' || node_id as node, node_id || chr(9) || split_feature || chr(9) || cast(split_value as varchar) as value from n0 where split_feature is not null")
def summary_lines(spark, d):
    n = trees(spark, d)
    return n.filter("not is_leaf").select(F.concat_ws(":", "tree_id", "node_id").alias("node"), F.concat_ws("\t", "node_id", "split_feature", F.col("split_value").cast("string")).alias("value"))


@query(f"with {N} select n0.tree_id, n0.node_id, n0.parent_id, n0.depth, split_feature, split_value, median as first_median from n0 join lf using (tree_id, node_id) where feature = 'a'")
def forest_roundtrip(spark, d):
    out = text.from_nested(text.nested(trees(spark, d)))
    short = F.when(F.col("depth") == 0, "RT").otherwise(F.concat(F.lit("RT"), F.array_join(F.regexp_extract_all("node_id", F.lit(r"!F[^:]+:S[-+0-9.eE]+([LR])"), F.lit(1)), "")))
    out = out.withColumn("short", short)
    return out.select("tree_id", F.col("short").alias("node_id"), F.when(F.col("depth") > 0, F.expr("substring(short, 1, length(short) - 1)")).alias("parent_id"), "depth", "split_feature", "split_value", F.col("medians")[0].alias("first_median"))


# Names, parameters, sampling ------------------------------------------------------------


@query("select p_partkey as pos, p_brand || case when r > 0 then cast(r as varchar) || '_' else '_' end as name from (select p_partkey, p_brand, row_number() over (partition by p_brand order by p_partkey) - 1 as r from part)")
def header_dedupe(spark, d):
    names = table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.concat(F.col("p_brand"), F.lit("-")).alias("name"))
    out = text.unique_names(names)
    return out.select("pos", F.concat(F.regexp_replace("name", "-([0-9]*)$", "$1"), F.lit("_")).alias("name"))


@query(f"with {M} select count(distinct feature) as features, count(distinct sample_id) as samples, count(*) as cells, 0 as nans, sum(case when value = 0 then 1 else 0 end)::bigint as zeros from m")
def matrix_density(spark, d):
    return density(lines(spark, d)).select("features", "samples", "cells", F.col("nans").cast("int"), "zeros")


@query("select case when n < 10 then n when n < 1000 then n // 3 * 2 when n < 5000 then n // 2 else n // 4 end as sample_sub, 3 as in_features, 4 as out_features, 'no' as drop_mode, 'branch' as prediction from (select count(distinct " + LINE_ID + ") as n from lineitem)")
def auto_parameters_lineitem(spark, d):
    p = auto_parameters(lines(spark, d))
    return spark.createDataFrame([(p.sample_sub, p.in_features, p.out_features, p.drop.value, p.prediction)], "sample_sub long, in_features int, out_features int, drop_mode string, prediction string")


@query("select 12 as trees, 5 as leaf_size, 'variance' as split, 'truncate' as prediction")
def command_line(spark, d):
    given, _ = parse(["-t", "12", "-l", "5", "-sm", "variance", "-m", "truncate"])
    p = Parameters(**given)
    return spark.createDataFrame([(p.trees, p.leaf_size, p.split, p.prediction)], "trees int, leaf_size int, split string, prediction string")


def dice(key: str) -> str:
    """A number from 0 to 1,000,002 for a whole number, in SQL that Spark and DuckDB read alike: draws that both can make."""
    return f"(({key}) * 7919 + 12345) % 1000003"


def even(key: str) -> Column:
    return (F.expr(dice(key)) + F.lit(0.5)) / F.lit(1000003.0)


EVEN = "(({}) + 0.5) / 1000003.0::double"


@query(f"select c_nationkey, c_custkey from (select *, row_number() over (partition by c_nationkey order by {dice('c_custkey')}, c_custkey) as r from customer) where r <= 20")
def sample_without_replacement(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey")
    return sampling.without_replacement(c, 20, ["c_nationkey"], "c_custkey", 7, F.expr(dice("c_custkey")))


@query(f"select c_nationkey, c_custkey from (select *, row_number() over (partition by c_nationkey order by ln({EVEN.format(dice('c_custkey'))}) / c_acctbal desc, c_custkey) as r from customer where c_acctbal > 0) where r <= 20")
def sample_weighted(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", F.greatest("c_acctbal", F.lit(0.0)).alias("w"))
    return sampling.weighted(c, 20, ["c_nationkey"], "c_custkey", "w", 7, even("c_custkey")).select("c_nationkey", "c_custkey")


#: Draws among suppliers by the size of their balance, and the supplier at each place of the cumulative weights.
PLACES = "s as (select s_suppkey, s_suppkey % 16 as bucket, abs(s_acctbal)::double as w from supplier where s_acctbal <> 0), c as (select *, sum(w) over (order by bucket, s_suppkey) as upto from s), t as (select sum(w) as total from s)"


def drawn_suppliers(sql: str) -> str:
    return f"with {PLACES}, d as (select draw, {EVEN.format(dice('draw'))} * total as u from {sql} r(draw), t) select draw, (select arg_min(s_suppkey, upto) from c where upto > u) as s_suppkey from d"


def balances(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", F.abs("s_acctbal").alias("w"))


@query(drawn_suppliers("range(500)"))
def sample_with_replacement(spark, d):
    return sampling.with_replacement(balances(spark, d), 500, "s_suppkey", "w", 7, even("id"), F.col("s_suppkey") % 16)


@query(drawn_suppliers("range(1)"))
def sample_choice(spark, d):
    return sampling.choice(balances(spark, d), "s_suppkey", "w", 7, even("id"), F.col("s_suppkey") % 16)


@query(f"select c_custkey, ({dice('c_custkey')} % 5)::int as piece from customer")
def sample_pieces(spark, d):
    return sampling.pieces(table(spark, d, "customer").select("c_custkey"), 5, "c_custkey", 3, F.expr(dice("c_custkey")))


@query(f"with {NM}, e as (select sample_id, feature, abs(value) as w, ln({EVEN.format(dice('sample_id * 3 + ascii(feature)'))}) as l from nm where abs(value) > 0) select sample_id, feature from e order by l / w desc limit 50")
def sample_error_cells(spark, d):
    return sampling.cells_by_error(customers(spark, d), 50, 3, even("sample_id * 3 + ascii(feature)"))


@query(f"with {NM} select sample_id, feature, value, {EVEN.format(dice('sample_id * 3 + ascii(feature)'))} < 0.3 as held_out from nm")
def sample_mask(spark, d):
    return sampling.masked(customers(spark, d), 0.3, 3, even("sample_id * 3 + ascii(feature)"))


@query("select cast(s_suppkey as varchar) as sample_id, 'c' || f as feature, case when f = 0 then s_acctbal else cast(s_nationkey as double) end as value from supplier, range(2) t(f)")
def text_matrix(spark, d):
    path = f"{_folder(spark)}/matrix"
    s = table(spark, d, "supplier").orderBy("s_suppkey")
    s.select(F.concat_ws(" ", F.col("s_acctbal").cast("string"), F.col("s_nationkey").cast("string"))).coalesce(1).write.mode("overwrite").text(path)
    s.select(F.col("s_suppkey").cast("string")).coalesce(1).write.mode("overwrite").text(path + ".samples")
    header = spark.createDataFrame([(0, "c0"), (1, "c1")], "pos long, name string")
    return text.read_matrix(spark, path, header, text.read_sample_names(spark, path + ".samples"))


def _folder(spark: SparkSession) -> str:
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{root.rstrip('/')}/thicket-text" if root else tempfile.mkdtemp(prefix="thicket-text-")


# Whole forests ---------------------------------------------------------------------------

SMALL = Parameters(trees=4, leaf_size=25, in_features=5, out_features=5, sample_sub=100, drop="no", prediction="branch", seed=11)


def checkpoints(spark: SparkSession) -> None:
    """Iterations cut their lineage in the session's checkpoint folder; one is set only where there is none."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="thicket-"))


@query()
def forest_train(spark, d):
    return forest.fit(vectors(spark, d), SMALL).select("tree_id", "node_id", "depth", "split_feature", "split_value", "is_leaf", "n_samples")


@query()
def forest_impute(spark, d):
    m = vectors(spark, d)
    seen = m.withColumn("value", F.when((F.col("sample_id") * 7 + F.ascii(F.substring("feature", 2, 1)) * 13) % 10 != 0, F.col("value")))
    nodes = forest.fit(seen.withColumn("value", F.coalesce("value", F.lit(float("nan")))), Parameters(**(SMALL.__dict__ | {"drop": DropMode.NANS})))
    got = predict.predict(nodes, seen, mode=DropMode.NANS)
    return stats.errors(m.join(seen.filter("value is null").select("sample_id", "feature"), ["sample_id", "feature"]), got)


@query()
def boost_two_epochs(spark, d):
    p = Parameters(**(SMALL.__dict__ | {"epochs": 2, "epoch_duration": 2, "boost": "additive"}))
    m = vectors(spark, d)
    return stats.errors(m, boost.Boosted(m, p).run().predict())


@query(f"with {N} select tree_id, node_id, lf.feature, round(any_value(lf.median), 6) as median, round(any_value(dispersion), 6) as dispersion, round(median(value), 6) as true_median, round(mad(value), 6) as true_mad from lf join (select tree_id, node_id, unnest(samples) as id from n0) using (tree_id, node_id) join nm on cast(nm.sample_id as varchar) = id and nm.feature = lf.feature group by tree_id, node_id, lf.feature")
def node_check(spark, d):
    out = analytics.checked(trees(spark, d), customers(spark, d))
    return out.select("tree_id", "node_id", "feature", *[r4(c, 6).alias(c) for c in ("median", "dispersion", "true_median", "true_mad")])


@query(f"""with {N}, up as (select n.tree_id, n.node_id, a.node_id as ancestor_id, n.split_feature as split, n.split_value, a.split_feature as ancestor_feature, case when n.node_id[len(a.node_id) + 1] = 'L' then '<' else '>' end as ancestor_sign, a.split_value as ancestor_split, a.samples
  from n0 n join n0 a on a.tree_id = n.tree_id and a.depth < n.depth and starts_with(n.node_id, a.node_id) where n.split_feature is not null),
parted as (select u.tree_id, u.node_id, u.ancestor_id, id, case when value > split_value then '>' else '<' end as sign from (select *, unnest(samples) as id from up) u join nm on cast(nm.sample_id as varchar) = id and nm.feature = split where value is not null),
th as (select tree_id, node_id, ancestor_id, sign, feature, median(value) as m, case when count(*) < 2 then 0 else mad(value) end as d from parted join nm on cast(nm.sample_id as varchar) = id where value is not null group by all)
select up.tree_id, up.node_id, up.ancestor_id, split, sign, up.split_value, ancestor_feature, ancestor_sign, ancestor_split, th.feature as output, round(k.local_gain - (r.cov - case when m <> 0 then d / m else 0 end), 6) as interaction
  from up join th using (tree_id, node_id, ancestor_id) join n0 kid on kid.tree_id = up.tree_id and kid.parent_id = up.node_id and (kid.side = 'L') = (sign = '<') join lf k on k.tree_id = up.tree_id and k.node_id = kid.node_id and k.feature = th.feature join lf r on r.tree_id = up.tree_id and r.node_id = up.ancestor_id and r.feature = th.feature""")
def split_interactions(spark, d):
    return analytics.interactions(trees(spark, d), customers(spark, d)).withColumn("interaction", r4("interaction", 6))


@query()
def leaf_weight_solution(spark, d):
    m = vectors(spark, d)
    nodes = forest.fit(m, SMALL)
    feature = nodes.select(F.element_at("features", 1).alias("f")).agg(F.min("f")).first()[0]
    return analytics.leaf_weights(nodes, m, feature)


@query()
def node_components(spark, d):
    m = vectors(spark, d)
    nodes = forest.fit(m, SMALL)
    names = sorted({f for r in nodes.filter("node_id = 'RT'").select("features").collect() for f in r[0]})
    out = analytics.principal_components(analytics.gain_vectors(nodes, names), names, 2)
    from pyspark.ml.functions import vector_to_array

    return out.select("tree_id", "node_id", vector_to_array("components").alias("c")).select("tree_id", "node_id", F.col("c")[0].alias("x"), F.col("c")[1].alias("y"))


def _prepared(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        checkpoints(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _prepared(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
