"""Near-duplicates by SetSketch registers.

A register holds the least of exponential hash values of a document's shingles, on a
logarithmic scale and cut off at both ends. Registers of sets merge by their maximum,
and agree the oftener the more alike the sets are, so bands of registers find
candidates. The likelihood of how many registers are larger, smaller and equal, given
both sizes, estimates the Jaccard index jointly; pairs that may reach the limit are
confirmed on the full shingle sets.

Documents with equal sets are one class from the start. Each band bucket then links
its members to its least member only. Components of the confirmed links leave few
buckets with more than one component; there, pairs across components are estimated in
blocks of bounded size, so no link between candidates is lost and no task sees a whole
hot bucket; the largest component's blocks don't meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm.components import components
from thicket.llm.ordered import LAST
from thicket.llm.shared import WordHash, attach, batches, mix, shared_table, shingles, small_batches, text_bytes

#: Registers, the first of them in bands of ROWS; the base of their scale, its start, and its last step.
REGISTERS, BANDS, ROWS, BASE, RATE, STEPS = 160, 20, 4, 1.02, 20.0, (1 << 16) - 2
#: How far below the limit an estimate may be for the pair to be confirmed on full sets: five standard errors.
MARGIN = 0.14
#: Least share of equal registers of a pair worth estimating. That share is about the Jaccard
#: index; at an index of 0.8 it is below this with a probability under 1e-8.
EQUAL = 0.6
#: Members of a bucket that are compared with each other at once, and ids that may be broadcast.
BLOCK, MANY = 1024, 1_000_000

_rng = np.random.default_rng(20210)
_FACTOR = _rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingles of a text's word hashes, ascending; fewer words are one shingle."""
    if 0 < len(hashes) < width:
        return mix(shingles(hashes, len(hashes)) + np.uint64(len(hashes)))
    return np.unique(shingles(hashes, width))


def registers(members: np.ndarray) -> np.ndarray:
    """The sketch of a set of 64-bit hashes."""
    x = (members >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(least, (_FACTOR[:, None] * x[None, i : i + 2048] + _SHIFT[:, None]).min(1), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(exponential / RATE) / np.log(BASE)), 0, STEPS + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each sketch (rows)."""
    x = sketches.reshape(-1, REGISTERS)[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), x.shape[:2])
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + x[:, :, i])
    return key


def jaccard(larger: np.ndarray, smaller: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard index of sets of sizes n and m, by how many of the first's
    registers are larger and smaller than the second's."""
    equal = REGISTERS - larger - smaller
    u, v = n / (n + m), m / (n + m)
    p = lambda x: -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / np.log(BASE)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)

    def value(j: np.ndarray) -> np.ndarray:
        plus, minus = p(u - v * j), p(v - u * j)
        return larger * np.log(plus) + smaller * np.log(minus) + equal * np.log(np.maximum(1 - plus - minus, 1e-12))

    for _ in range(40):  # the likelihood is concave
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        up = value(a) < value(b)
        low, high = np.where(up, a, low), np.where(up, high, b)
    return (low + high) / 2


def sketched(docs: DataFrame, width: int, scope: str) -> DataFrame:
    """A shared table ``doc_id, id, t, n, key, regs, row``: sizes, digests and sketches of the sets,
    hashes of the texts, and a number for each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("id", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("regs", pa.binary())])

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        memo = WordHash()
        for batch in parts:
            for doc_id, t, text in zip(batch.column("doc_id").to_pylist(), batch.column("t").to_pylist(), text_bytes(batch), strict=True):
                s = shingle_set(memo.all(text.lower().split()), width)
                yield doc_id, LAST if doc_id is None else doc_id, t, len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, registers(s).tobytes() if len(s) else None

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("t"), F.col("text").cast("binary").alias("text"))
    out = plain.mapInArrow(lambda p: batches(rows(p), schema), "doc_id long, id long, t long, n long, key binary, regs binary")
    return shared_table(out.withColumn("row", F.monotonically_increasing_id()), "sketches", scope)


def text_hash() -> Column:
    """With the doc_id, this says which text a row has."""
    return F.xxhash64(F.col("text").cast("binary"))


def full_sets(docs: DataFrame, ids: DataFrame, reps: DataFrame, width: int, scope: str) -> DataFrame:
    """A shared table ``id, set`` of the shingle sets of the classes ``ids``."""
    schema = pa.schema([("id", pa.int64()), ("set", pa.binary())])

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        memo = WordHash()
        for batch in parts:
            for i, text in zip(batch.column("id").to_pylist(), text_bytes(batch), strict=True):
                yield i, shingle_set(memo.all(text.lower().split()), width).tobytes()

    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("least"), text_hash().alias("t"), F.col("text").cast("binary").alias("text"))
    few = ids.limit(MANY + 1).count() <= MANY
    known = reps.select("id", "least", "t").join(F.broadcast(ids) if few else ids, "id")
    chosen = plain.join(F.broadcast(known) if few else known, ["least", "t"]).select("id", "text")
    return shared_table(chosen.mapInArrow(lambda p: batches(rows(p), schema, 500), "id long, set binary").dropDuplicates(["id"]), "sets", scope)


def likely(pairs: DataFrame, reps: DataFrame, limit: float) -> DataFrame:
    """Those of the pairs ``a, b`` whose estimate may reach the limit."""
    sides = [reps.select(F.col("id").alias(f"{s}_id"), F.col("n").alias(f"{s}_n"), F.col("regs").alias(f"{s}_regs")) for s in "xy"]
    joined = pairs.join(sides[0], F.col("a") == F.col("x_id")).join(sides[1], F.col("b") == F.col("y_id")).select("a", "b", "x_n", "y_n", "x_regs", "y_regs")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            if not batch.num_rows:
                continue
            a, b, n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
            keep = jaccard((x > y).sum(1), (x < y).sum(1), n, m) >= limit - MARGIN
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int, scope: str) -> DataFrame:
    """Those of the pairs ``a, b`` whose full sets reach the limit."""
    pairs = pairs.checkpoint()
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = full_sets(docs, ids, reps, width, scope)
    joined = pairs.join(sets.select(F.col("id").alias("x_id"), F.col("set").alias("x")), F.col("a") == F.col("x_id")).join(sets.select(F.col("id").alias("y_id"), F.col("set").alias("y")), F.col("b") == F.col("y_id")).select("a", "b", "x", "y")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            found = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

    return joined.mapInArrow(run, "a long, b long").checkpoint()


def across(members: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int, scope: str) -> DataFrame:
    """Confirmed links between components among the buckets' members ``bucket, id, component``.

    Members of a bucket's largest component meet those of the others only, so a large
    group with few strangers is dealt out once for each block of those. Pairs are
    estimated and confirmed where their block is, and those that links found there
    connect already are skipped, so only links leave a task, never candidates.
    """
    limit = percent / 100
    sets = full_sets(docs, members.select("id").distinct(), reps, width, scope)
    # Blocks 0 up to ``blocks`` hold the members outside a bucket's largest component, and the next ``wide`` ones that component.
    counts = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("bucket").alias("k")).agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("all"))
    held = lambda n: F.ceil(n / BLOCK).cast("int")
    counts = counts.select("k", F.col("m.component").alias("main"), held(F.col("m.n")).alias("wide"), held(F.col("all") - F.col("m.n")).alias("blocks")).checkpoint()
    inside = F.col("component") == F.col("main")
    rows = attach(members, counts, F.col("bucket") == F.col("k")).withColumn("own", F.when(inside, F.col("blocks") + F.pmod(F.xxhash64("id"), F.col("wide"))).otherwise(F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("blocks")).otherwise(F.col("blocks") + F.col("wide")) - 1)))
    rows = rows.select("bucket", "id", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = rows.join(reps.select("id", "n", "regs"), "id").join(sets, "id")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("bucket", "i", "j", "own", "id", "component", "n", "regs", "set").repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def compare(group: list[tuple]) -> Iterator[tuple[int, int]]:
        i, j = group[0][1:3]
        own, ids, comp, n = (np.array([g[k] for g in group]) for k in (3, 4, 5, 6))
        x = np.frombuffer(b"".join(g[7] for g in group), np.uint16).reshape(-1, REGISTERS)
        bands = band_keys(x)
        here = int(np.flatnonzero((bands == np.uint64(group[0][0] % (1 << 64))).all(0))[0])
        root = {c: c for c in set(comp.tolist())}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        for k in range(len(group)):
            if i != j and own[k] != i:
                continue
            others = np.flatnonzero((comp != comp[k]) & ((own == j) if i != j else (ids > ids[k])))
            if not len(others):
                continue
            # A pair counts in the first band that it shares.
            others = others[~(bands[others, :here] == bands[k, :here]).any(1)] if here else others
            if not len(others):
                continue
            others = others[(x[others] == x[k]).sum(1) >= EQUAL * REGISTERS]
            if not len(others):
                continue
            y = x[others]
            est = jaccard((x[k] > y).sum(1), (x[k] < y).sum(1), np.full(len(others), n[k]), n[others])
            mine = np.frombuffer(group[k][8], np.uint64)
            for o in others[est >= limit - MARGIN]:
                if (p := find(int(comp[k]))) == (q := find(int(comp[o]))):
                    continue
                theirs = np.frombuffer(group[o][8], np.uint64)
                shared = len(np.intersect1d(mine, theirs, True))
                if 100 * shared >= percent * (len(mine) + len(theirs) - shared):
                    root[p] = q
                    yield min(ids[k], ids[o]), max(ids[k], ids[o])

    def pairs(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        held: list[tuple] = []
        for batch in parts:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != held[0][:3]:
                    yield from compare(held)
                    held = []
                held.append(row)
        if held:
            yield from compare(held)

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    return rows.mapInArrow(lambda p: batches(((int(a), int(b)) for a, b in pairs(p)), schema), "a long, b long")


def star_links(members: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int, scope: str) -> tuple[DataFrame, DataFrame]:
    """Confirmed links of members with the pivots of their buckets, and the components of those.

    First each document meets one pivot, that of its largest bucket, and then all pivots
    that are in a different component still. So a group of thousands of near copies
    mostly costs a pair a document, not one for each bucket.
    """
    pairs = members.groupBy(F.col("pivot").alias("a"), F.col("id").alias("b")).agg(F.max("size").alias("size")).checkpoint()
    links, known = None, None
    for last in (False, True):
        if known is not None:
            side = lambda x: known.select(F.col("node").alias(f"{x}_node"), F.col("component").alias(f"{x}_c"))  # noqa: B023, E731
            pairs = attach(attach(pairs, side("a"), F.col("a") == F.col("a_node"), "left"), side("b"), F.col("b") == F.col("b_node"), "left")
            pairs = pairs.filter(F.coalesce("a_c", "a") != F.coalesce("b_c", "b")).select("a", "b", "size").join(chosen.select("a", "b"), ["a", "b"], "left_anti").checkpoint()  # noqa: F821
            if not pairs.limit(1).count():
                break
        chosen = pairs if last else pairs.groupBy("b").agg(F.max(F.struct("size", (-F.col("a")).alias("a"))).alias("m")).select((-F.col("m.a")).alias("a"), "b", F.col("m.size").alias("size")).checkpoint()
        new = confirmed(likely(chosen.select("a", "b"), reps, percent / 100), reps, docs, width, percent, scope)
        links = new if links is None else links.unionByName(new)
        known = components(links)
    return links, known


def near_groups(docs: DataFrame, width: int = 3, percent: int = 85, scope: str = "") -> DataFrame:
    """Group documents whose shingle sets have a Jaccard index of ``percent`` or more.

    Returns ``doc_id, n_shingles, component_id, kept``: the size of the set of distinct
    ``width``-word shingles (ASCII lower case), the least doc_id reachable over links,
    and whether that is the document itself. Fewer words than ``width`` are one shingle;
    a document without words, or with null text, is linked with nothing.

    A link is found with probability above 1 - 1e-6 at a limit of 85 %: 20 bands of 4
    registers. Rows are linked by their texts alone, whatever ids they share. Null
    doc_id: as the largest; its component is null if it has no smaller member. One row
    of each group is kept; where several have its least doc_id, or null, any one of
    them. Very long texts are read whole. Other columns are ignored. An empty table
    gives an empty result.
    """
    return near_rows(docs, width, percent, scope).select("doc_id", "n_shingles", "component_id", "kept")


def near_rows(docs: DataFrame, width: int, percent: int, scope: str) -> DataFrame:
    """As ``near_groups``, with ``t``, the text's hash, and ``copy``: a row that isn't kept, of the doc_id and text of the kept one."""
    small_batches(docs.sparkSession)
    table = sketched(docs, width, scope)
    some = table.filter("n > 0")
    # A class of equal sets has a number, the id of everything up to the components, and a row with the least doc_id.
    reps = some.groupBy("key").agg(F.min(F.struct("id", "row", "t", "n", "regs")).alias("r"), F.count(F.lit(1)).alias("copies"))
    reps = shared_table(reps.select("key", "copies", F.monotonically_increasing_id().alias("id"), F.col("r.id").alias("least"), "r.row", "r.t", "r.n", "r.regs"), "classes", scope)

    def bands(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            if batch.num_rows:
                keys = band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS))], ["bucket", "id"])

    keyed = reps.select("id", "regs").mapInArrow(bands, "bucket long, id long")
    full = keyed.groupBy("bucket").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("size")).filter("size > 1").select(F.col("bucket").alias("k"), "pivot", "size")
    full = shared_table(full, "buckets", scope)
    members = shared_table(attach(keyed, full, F.col("bucket") == F.col("k")).filter("id <> pivot").select("bucket", "id", "pivot", "size"), "members", scope)
    links, first = star_links(members, reps, docs, width, percent, scope)
    # Buckets in which pairs of different components haven't been compared: none with the pivot is among them.
    open_ = members.filter("size > 2").select("bucket", "id")
    open_ = attach(open_, first.select(F.col("node").alias("v"), "component"), F.col("id") == F.col("v"), "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    open_ = open_.checkpoint()
    mixed = open_.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select(F.col("bucket").alias("k")).checkpoint()
    rest = attach(open_, mixed, F.col("bucket") == F.col("k"), "left_semi")
    last = first
    if mixed.limit(1).count():
        more = across(rest, reps, docs, width, percent, scope).distinct().checkpoint()
        last = components(links.unionByName(more))
    classes = reps.select("key", "id", "copies", F.struct("least", "row", "t").alias("own")).join(last, F.col("id") == F.col("node"), "left").filter("copies > 1 or component is not null").select("key", "component", "own")
    first = classes.filter("component is not null").groupBy(F.col("component").alias("c")).agg(F.min("own").alias("all")).checkpoint()
    groups = attach(classes, first, F.col("component") == F.col("c"), "left").select(F.col("key").alias("k"), F.coalesce("all", "own").alias("s")).checkpoint()
    out = attach(table.select("doc_id", "id", "t", "n", "key", "row"), groups, F.col("key") == F.col("k"), "left").withColumn("least", F.coalesce("s.least", "id"))
    kept = F.coalesce(F.col("row") == F.col("s.row"), F.lit(True))
    copy = ~kept & (F.col("id") == F.col("s.least")) & (F.col("t") == F.col("s.t"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("least") < LAST, F.col("least")).alias("component_id"), kept.alias("kept"), "t", copy.alias("copy"))
