"""Near-duplicates by an exact Jaccard join on word n-grams.

Every document's shingles are put in one global order, rare ones first. Two sets that
are alike enough then share a shingle near the front of both, so only documents that
share one of those prefix shingles are compared, and of them only pairs that pass

* the length filter (sizes too different can't reach the limit),
* the positional filter (what follows the common shingle must be enough), and
* the suffix filter (parts of what follows must have similar sizes).

The order takes document frequencies over all documents. Shingles go to the range that
their hash says, packed by document; there those that stand in one set alone are
dropped, which is nearly all of them, and each set gets back the others with their
frequency. As a shingle of one set alone is rarer than any other, a set's size tells
how many of them lead its order, and the order of the rest is all that is needed.

Documents with equal sets are one class from the start. A bucket of a prefix shingle
links its members to its least member first. Where several components are left, the
members of buckets that have some in common are compared once, in blocks and between
components only, so a large group of copies costs a pair a document. Pairs are verified
on full sets, once each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.components import components
from thicket.llm.ordered import LAST
from thicket.llm.setsketch import confirmed, shingle_set, text_hash
from thicket.llm.shared import WordHash, attach, batches, release, shared_table, small_batches, text_bytes

#: Bytes of text whose shingles make a range, the least number of ranges as bits, and the most that a task deals to at once.
RANGE_BYTES, LEAST_BITS, MOST_BITS = 8 << 20, 7, 11
#: Partitions that ranges are dealt to at most, beyond the session's setting; shingles that a task holds before it deals them out.
MOST_PARTS, HELD = 20_000, 1_000_000
#: Parts of a suffix whose sizes are compared; members that are compared at once, and those of a unit of several buckets at most.
PARTS, BLOCK, LARGE = 16, 1024, 16_384

DEALT = pa.schema([("kind", pa.int32()), ("range", pa.int64()), ("doc_id", pa.int64()), ("id", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("owners", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary())])
DEALT_SQL = "kind int, range long, doc_id long, id long, t long, n long, key binary, owners binary, counts binary, hashes binary"
FOUND = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("id", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("owner", pa.int64()), ("tokens", pa.binary()), ("ranks", pa.binary())])
FOUND_SQL = "kind int, doc_id long, id long, t long, n long, key binary, owner long, tokens binary, ranks binary"


def owner_of(key: bytes) -> int:
    """A set's number, from its digest."""
    return int(np.frombuffer(key, np.int64, 1)[0])


def dealt(hashes: np.ndarray, owners: np.ndarray, lens: np.ndarray, bits: int, width: int) -> Iterator[tuple]:
    """Rows ``range, owners, counts, hashes`` of sets' shingles by the leading ``bits``: of each set that
    has any in the range its number and how many (255 a time), and the last ``width`` bytes of them."""
    r = (hashes >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
    order = np.argsort(r, kind="stable")
    r, at, hashes = r[order], np.repeat(np.arange(len(lens)), lens)[order], hashes[order]
    cut = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1], [True]]))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        start = np.flatnonzero(np.concatenate([[True], at[a + 1 : b] != at[a : b - 1]]))
        size = np.diff(np.concatenate([start, [b - a]]))
        more = -(-size // 255)  # entries that a set needs
        own = np.repeat(owners[at[a:b][start]], more)
        counts = np.full(len(own), 255, np.uint8)
        counts[np.cumsum(more) - 1] = size - 255 * (more - 1)
        yield int(r[a]), own.tobytes(), counts.tobytes(), np.ascontiguousarray(hashes[a:b].view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def widened(blob: bytes, width: int) -> np.ndarray:
    """The numbers whose last ``width`` bytes these are, the others 0."""
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return out.view(np.uint64).ravel()


def repeated(hashes: np.ndarray, owners: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each set its shingles that stand in other sets too, and the rank of their frequency (8 a doubling)."""
    order = np.argsort(hashes)
    s = hashes[order]
    same = s[1:] == s[:-1]
    twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    if not twice.any():
        return
    some = order[twice]
    h, o = hashes[some], owners[some]
    order = np.lexsort((o, h))
    h, o = h[order], o[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])  # copies of a set count once
    h, o = h[new], o[new]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    df = np.diff(np.concatenate([start, [len(h)]]))
    df = np.repeat(df, df)
    keep = df > 1
    h, o, rank = h[keep], o[keep], np.minimum(8 * np.log2(df[keep]), 255).astype(np.uint8)
    order = np.argsort(o, kind="stable")
    h, o, rank = h[order], o[order], rank[order]
    cut = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1], [True]])) if len(o) else np.zeros(1, int)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(o[a]), h[a:b], rank[a:b]


def described(docs: DataFrame, width: int, scope: str) -> DataFrame:
    """A shared table of FOUND_SQL. Kind 0: a document, the size and digest of its set. Kind 1: a part of
    a set's shingles that other sets have too, with their ranks."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("t"), F.col("text").cast("binary").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = max(LEAST_BITS, (total // RANGE_BYTES).bit_length())
    # More ranges than a task can fill rows for are reached in two steps, by leading bits first.
    steps = [bits] if bits <= MOST_BITS else [-(-bits // 2), bits]
    last = 6  # bytes; with the range's bits that's all that tells shingles apart here

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        memo, sets, owners, held, row = WordHash(), [], [], 0, 0

        def flush() -> Iterator[tuple]:
            if sets:
                for r, *blobs in dealt(np.concatenate(sets), np.array(owners, np.int64), np.array([len(x) for x in sets]), steps[0], last if len(steps) == 1 else 8):
                    yield 1, r, *[None] * 5, *blobs

        for batch in parts:
            for doc_id, t, text in zip(batch.column("doc_id").to_pylist(), batch.column("t").to_pylist(), text_bytes(batch), strict=True):
                s = shingle_set(memo.all(text.lower().split()), width)
                key = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                own = owner_of(key) if key else 0
                row += 1
                yield 0, -1 - ((own ^ row * 0x9E3779B1) & 0xFFFF), doc_id, LAST if doc_id is None else doc_id, t, len(s), key, None, None, None
                if len(s) and (not owners or owners[-1] != own):
                    sets.append(s)
                    owners.append(own)
                    held += len(s)
                if held >= HELD:
                    yield from flush()
                    sets, owners, held = [], [], 0
        yield from flush()

    def again(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Ranges of the first step, in order, dealt to those of the second."""
        at, held, size = None, [], 0

        def flush() -> Iterator[tuple]:
            if held:
                h, o, c = (np.concatenate(x) for x in zip(*held, strict=True))
                for r, *blobs in dealt(h, o, c.astype(np.int64), bits, last):
                    yield 1, r, *[None] * 5, *blobs

        for batch in parts:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] == 0:
                    yield row
                    continue
                if row[1] != at or size >= HELD:
                    yield from flush()
                    at, held, size = row[1], [], 0
                held.append((np.frombuffer(row[9], np.uint64), np.frombuffer(row[7], np.int64), np.frombuffer(row[8], np.uint8)))
                size += len(row[9]) // 8
        yield from flush()

    def reduce(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, held = None, []

        def close() -> Iterator[tuple]:
            if held:
                h = np.concatenate([widened(x[0], last) for x in held]) | np.uint64(at << (64 - bits))
                o = np.concatenate([np.repeat(np.frombuffer(x[1], np.int64), np.frombuffer(x[2], np.uint8)) for x in held])
                held.clear()
                for own, tokens, ranks in repeated(h, o):
                    yield 1, *[None] * 5, own, tokens.tobytes(), ranks.tobytes()

        for batch in parts:
            for kind, r, doc_id, i, t, n, key, own, counts, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    yield 0, doc_id, i, t, n, key, owner_of(key) if key else None, None, None
                    continue
                if r != at:
                    yield from close()
                    at = r
                held.append((hashes, own, counts))
        yield from close()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = plain.mapInArrow(lambda p: batches(rows(p), DEALT, 50), DEALT_SQL)
    for step in steps[1:]:
        out = out.repartition(max(n, min(1 << steps[0], MOST_PARTS)), "range", F.pmod(F.xxhash64("owners"), F.lit(16))).sortWithinPartitions("range").mapInArrow(lambda p: batches(again(p), DEALT, 50), DEALT_SQL)
    out = out.repartition(max(n, min(1 << bits, MOST_PARTS)), "range").sortWithinPartitions("range")
    return shared_table(out.mapInArrow(lambda p: batches(reduce(p), FOUND, 1000), FOUND_SQL), "shingles", scope)


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Fewest common shingles with which sets of these sizes reach the limit."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """How far into its order a set of this size has the first shingle that it shares with any partner."""
    return n - -(-percent * n // 100) + 1


def index_length(n: int, percent: int) -> int:
    """The same for partners that aren't smaller."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def ordered(lists: DataFrame, reps: DataFrame, scope: str) -> DataFrame:
    """A shared table ``id, n, tokens``: each class's shingles that others have too, rare ones first."""
    parts = lists.groupBy(F.col("owner").alias("o")).agg(F.collect_list("tokens").alias("tokens"), F.collect_list("ranks").alias("ranks"))
    both = parts.join(reps.select("id", "owner", "n"), F.col("o") == F.col("owner")).select("id", "n", "tokens", "ranks")
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())])

    def rows(batches_: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches_:
            for i, n, tokens, ranks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t, r = np.frombuffer(b"".join(tokens), np.uint64), np.frombuffer(b"".join(ranks), np.uint8)
                yield i, n, t[np.lexsort((t, r))].tobytes()

    return shared_table(both.mapInArrow(lambda p: batches(rows(p), schema, 500), "id long, n long, tokens binary"), "in-order-shingles", scope)


PREFIX_SQL = "token long, id long, n long, pos long, short boolean, rest binary"


def prefixes(sets: DataFrame, percent: int, scope: str) -> DataFrame:
    """A shared table of PREFIX_SQL: a class's prefix shingles, their places in its order, whether partners that
    aren't smaller find it by them, and how many of the shingles after them lie in each of PARTS parts."""
    schema = pa.schema([("token", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("pos", pa.int64()), ("short", pa.bool_()), ("rest", pa.binary())])

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in parts:
            for i, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = np.frombuffer(blob, np.uint64)
                alone = n - len(t)
                m = min(len(t), prefix_length(n, percent) - alone)
                if m <= 0:
                    continue
                part = (t % np.uint64(PARTS)).astype(np.int64)
                after = np.bincount(part, minlength=PARTS) - np.cumsum(np.eye(PARTS, dtype=np.int64)[part[:m]], 0)
                after = np.minimum(after, 0xFFFF).astype(np.uint16)
                short = index_length(n, percent)
                for k in range(m):
                    yield int(t[k].view(np.int64)), i, n, alone + k, alone + k < short, after[k].tobytes()

    return shared_table(sets.mapInArrow(lambda p: batches(rows(p), schema), PREFIX_SQL), "prefixes", scope)


def passing(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], percent: int) -> np.ndarray:
    """Which pairs of members ``id, n, pos, short, rest`` of a bucket pass all filters, if its shingle is their first in common."""
    (i, n, p, s, h), (j, m, q, u, g) = x, y
    first = (n < m) | ((n == m) & (i < j))
    low, high = np.minimum(n, m), np.maximum(n, m)
    need = least_overlap(n, m, percent)
    ok = np.where(first, s, u) & (100 * low >= percent * high) & (np.minimum(n - p, m - q) >= need)
    where = np.flatnonzero(ok)
    if len(where):
        broad = np.broadcast_shapes(h.shape, g.shape)
        apart = np.abs(np.broadcast_to(h, broad)[where].astype(np.int64) - np.broadcast_to(g, broad)[where]).sum(1)
        ok[where] = (np.broadcast_to(p + q, ok.shape)[where] + apart) <= (n + m - 2 * need)[where]
    return ok


def rests(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint16).reshape(-1, PARTS)


def with_pivots(buckets: DataFrame, pre: DataFrame, percent: int) -> DataFrame:
    """``a, b, size``: members of buckets with the least member, where the filters let them pass; and the largest bucket for which they do."""
    sides = attach(pre, buckets, F.col("token") == F.col("k")).filter(F.col("id") != F.col("v.id")).select("id", "n", "pos", "short", "rest", F.col("v.id").alias("a"), F.col("v.n").alias("vn"), F.col("v.pos").alias("vp"), F.col("v.short").alias("vs"), F.col("v.rest").alias("vr"), "size")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            if not batch.num_rows:
                continue
            c = [batch.column(i).to_pylist() if i in (4, 9) else batch.column(i).to_numpy(zero_copy_only=False) for i in range(11)]
            ok = passing((*c[:4], rests(c[4])), (*c[5:9], rests(c[9])), percent)
            yield pa.RecordBatch.from_arrays([pa.array(c[5][ok]), pa.array(c[0][ok]), pa.array(c[10][ok])], ["a", "b", "size"])

    return sides.mapInArrow(run, "a long, b long, size long").groupBy("a", "b").agg(F.max("size").alias("size"))


def star_links(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int, scope: str) -> tuple[DataFrame, DataFrame]:
    """Confirmed links among the pairs ``a, b, size``, and their components: each ``b`` meets the ``a`` of
    its largest bucket first, and then those that are in another component still."""
    pairs, links, known, done = pairs.checkpoint(), None, None, None
    for last in (False, True):
        if known is not None:
            side = lambda x: known.select(F.col("node").alias(f"{x}_node"), F.col("component").alias(f"{x}_c"))  # noqa: B023, E731
            pairs = attach(attach(pairs, side("a"), F.col("a") == F.col("a_node"), "left"), side("b"), F.col("b") == F.col("b_node"), "left")
            pairs = pairs.filter(F.coalesce("a_c", "a") != F.coalesce("b_c", "b")).select("a", "b", "size").join(done.select("a", "b"), ["a", "b"], "left_anti").checkpoint()
            if not pairs.limit(1).count():
                break
        done = pairs if last else pairs.groupBy("b").agg(F.max(F.struct("size", (-F.col("a")).alias("a"))).alias("m")).select((-F.col("m.a")).alias("a"), "b").checkpoint()
        new = confirmed(done.select("a", "b"), reps, docs, width, percent, scope)
        links = new if links is None else links.unionByName(new)
        known = components(links)
    return links, known


def meeting(members: DataFrame) -> DataFrame:
    """``kind, unit, id, component, n``: who may be alike, from members ``token, id, component, n`` of buckets.

    Buckets with members in common form one unit (kind 0), so that a class takes part in
    it once and not in each of its buckets; where that would have more than LARGE
    members, buckets stay units of their own (kind 1).
    """
    ends = members.groupBy(F.col("token").alias("t")).agg(F.min("id").alias("a"))
    linked = components(members.join(ends, F.col("token") == F.col("t")).select("a", F.col("id").alias("b")))
    cluster = linked.select(F.col("node").alias("v"), F.col("component").alias("unit"))
    large = linked.groupBy(F.col("component").alias("u")).agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > LARGE).select("u").checkpoint()
    rows = attach(members, cluster, F.col("id") == F.col("v")).drop("v")
    parts = [attach(rows, large, F.col("unit") == F.col("u"), how) for how in ("left_anti", "left_semi")]
    small = parts[0].select(F.lit(0).alias("kind"), "unit", "id", "component", "n").distinct()
    return small.unionByName(parts[1].select(F.lit(1).alias("kind"), F.col("token").alias("unit"), "id", "component", "n"))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set on the left has in common with each on the right."""
    out = np.zeros((len(left), len(right)), np.int32)
    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    rows = [np.repeat(np.arange(len(side)), size) for side, size in zip((left, right), sizes, strict=True)]
    x, y = np.concatenate(left), np.concatenate(right)
    both, kind = np.unique(np.concatenate([x, y]), return_inverse=True)
    kinds = kind[: len(x)], kind[len(x) :]
    counts = [np.bincount(k, minlength=len(both)) for k in kinds]
    # Shingles that many have: products of matrices. Others: their pairs, one by one.
    hot = np.flatnonzero(counts[0] * counts[1] > 4096)
    for at in range(0, len(hot), 512):
        some = hot[at : at + 512]
        place = np.full(len(both), -1)
        place[some] = np.arange(len(some))
        has = []
        for side, row, k in zip((left, right), rows, kinds, strict=True):
            m, p = np.zeros((len(side), len(some)), np.float32), place[k]
            m[row[p >= 0], p[p >= 0]] = 1
            has.append(m)
        out += (has[0] @ has[1].T).astype(np.int32)
    cold = (counts[0] > 0) & (counts[1] > 0)
    cold[hot] = False
    order = [np.argsort(k, kind="stable") for k in kinds]
    order = [o[cold[k[o]]] for o, k in zip(order, kinds, strict=True)]
    start = np.cumsum(np.where(cold, counts[1], 0)) - np.where(cold, counts[1], 0)
    for at in range(0, len(order[0]), 1 << 16):
        mine = order[0][at : at + (1 << 16)]
        k = kinds[0][mine]
        times = counts[1][k]
        j = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(start[k], times)
        np.add.at(out, (np.repeat(rows[0][mine], times), rows[1][order[1][j]]), 1)
    return out


def across(units: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links between the components of units ``kind, unit, id, component, n``, as far as they join what isn't joined yet.

    A large unit is divided by size first: partners are in the same step of sizes or the
    next. What is still large is dealt out in blocks, of which those of the largest
    component don't meet each other. Members bring the shingles that others have too:
    these tell all common ones, so only links leave a task, never candidates.
    """
    key = ["kind", "unit"]
    units = units.checkpoint()
    ratio = float(np.log(100 / percent))
    total = units.groupBy(F.col("kind").alias("tk"), F.col("unit").alias("tu")).agg(F.count(F.lit(1)).alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").drop("lo", "hi").checkpoint()
    rows = attach(units, total, (F.col("kind") == F.col("tk")) & (F.col("unit") == F.col("tu"))).drop("tk", "tu")
    home = F.when(F.col("members") > BLOCK, F.floor(F.log(F.col("n").cast("double")) / ratio)).otherwise(0).cast("int")
    rows = rows.withColumn("home", home).withColumn("band", F.explode(F.when(F.col("members") > BLOCK, F.array("home", F.col("home") + 1)).otherwise(F.array("home")))).withColumn("guest", F.col("band") != F.col("home"))
    counts = rows.groupBy(*key, "band", "component").agg(F.count(F.lit(1)).alias("m"), F.sum((~F.col("guest")).cast("int")).alias("hosts")).groupBy(F.col("kind").alias("ck"), F.col("unit").alias("cu"), F.col("band").alias("cb"))
    counts = counts.agg(F.max(F.struct("m", "component")).alias("x"), F.sum("m").alias("all"), F.sum("hosts").alias("hosts"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1 and hosts > 0")
    blocks = lambda x: F.ceil(x / BLOCK).cast("int")
    counts = counts.select("ck", "cu", "cb", F.col("x.component").alias("main"), blocks(F.col("x.m")).alias("wide"), blocks(F.col("all") - F.col("x.m")).alias("blocks")).checkpoint()
    inside = F.col("component") == F.col("main")
    rows = attach(rows, counts, (F.col("kind") == F.col("ck")) & (F.col("unit") == F.col("cu")) & (F.col("band") == F.col("cb")))
    rows = rows.withColumn("own", F.when(inside, F.col("blocks") + F.pmod(F.xxhash64("id"), F.col("wide"))).otherwise(F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("blocks")).otherwise(F.col("blocks") + F.col("wide")) - 1)))
    rows = rows.select(*key, "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "guest", "id", "component", "n")
    rows = rows.join(sets.select(F.col("id").alias("sid"), "tokens"), F.col("id") == F.col("sid")).drop("sid")
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, *key, "band", "i", "j").sortWithinPartitions(*key, "band", "i", "j")

    def compare(group: list[tuple]) -> Iterator[tuple[int, int]]:
        i, j = group[0][3:5]
        sides = [[g for g in group if g[5] == i], [g for g in group if g[5] == j]]
        if not sides[0] or not sides[1]:
            return
        guest, ids, comp, n = ([np.array([g[k] for g in side]) for side in sides] for k in range(6, 10))
        lists = [[np.frombuffer(g[10], np.uint64) for g in side] for side in sides]
        need = least_overlap(n[0][:, None], n[1][None], percent)
        fine = (comp[0][:, None] != comp[1][None]) & ~(guest[0][:, None] & guest[1][None]) & (np.minimum([len(x) for x in lists[0]], 1 << 62)[:, None] >= need)
        root: dict[int, int] = {}

        def find(c: int) -> int:
            root.setdefault(c, c)
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        for a, b in np.argwhere(fine & (overlaps(*lists) >= need)).tolist():
            if (p := find(int(comp[0][a]))) != (q := find(int(comp[1][b]))):
                root[p] = q
                yield tuple(sorted((int(ids[0][a]), int(ids[1][b]))))

    def links(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        held: list[tuple] = []
        for batch in parts:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:5] != held[0][:5]:
                    yield from compare(held)
                    held = []
                held.append(row)
        if held:
            yield from compare(held)

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    return rows.mapInArrow(lambda p: batches(links(p), schema), "a long, b long")


def joined(docs: DataFrame, width: int = 5, percent: int = 80, scope: str = "") -> DataFrame:
    """Group documents whose shingle sets have a Jaccard index of ``percent`` or more.

    Returns ``doc_id, n_shingles, component_id``: the size of the set of distinct
    ``width``-word shingles (ASCII lower case), and the least doc_id reachable over links.
    Fewer words than ``width`` are one shingle; a document without words, or with null
    text, is linked with nothing. No link is lost: the filters are exact, for any limit.

    Shingles are told apart by 64-bit hashes (in the join by the last 48 bits and those of
    the range). Rows are linked by their texts alone, whatever ids they share; a repeated
    row has its result each time. Null doc_id: as the largest; its component is null if it
    has no smaller member. Very long texts are read whole. Other columns are ignored. An
    empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    table = described(docs, width, scope)
    release(docs.sparkSession)  # the shingles' shuffle files
    rows = table.filter("kind = 0").select("doc_id", "id", "t", "n", "key", "owner")
    reps = rows.filter("n > 0").groupBy("key").agg(F.min(F.struct("id", "t", "n", "owner")).alias("r"), F.count(F.lit(1)).alias("copies"))
    reps = shared_table(reps.select("key", "copies", F.monotonically_increasing_id().alias("id"), F.col("r.id").alias("least"), "r.t", "r.n", "r.owner"), "classes", scope)
    sets = ordered(table.filter("kind = 1").select("owner", "tokens", "ranks"), reps, scope)
    pre = prefixes(sets, percent, scope)
    full = pre.groupBy("token").agg(F.min(F.struct("id", "n", "pos", "short", "rest")).alias("v"), F.count(F.lit(1)).alias("size")).filter("size > 1").select(F.col("token").alias("k"), "v", "size")
    full = shared_table(full, "buckets", scope)
    links, last = star_links(with_pivots(full, pre, percent), reps, docs, width, percent, scope)
    # Buckets of several components, in which no pair with the pivot is open.
    open_ = attach(pre, full.filter("size > 2").select("k", F.col("v.id").alias("pivot")), F.col("token") == F.col("k")).filter("id <> pivot").drop("k", "pivot")
    open_ = attach(open_, last.select(F.col("node").alias("w"), "component"), F.col("id") == F.col("w"), "left").withColumn("component", F.coalesce("component", "id")).drop("w").checkpoint()
    mixed = open_.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select(F.col("token").alias("k")).checkpoint()
    if mixed.limit(1).count():
        units = meeting(attach(open_, mixed, F.col("token") == F.col("k"), "left_semi").select("token", "id", "component", "n").checkpoint())
        more = across(units, sets, percent).distinct()
        last = components(links.unionByName(confirmed(more, reps, docs, width, percent, scope)))
    classes = reps.select("key", "id", "least").join(last, F.col("id") == F.col("node"), "left").select("key", "least", F.coalesce("component", "id").alias("component"))
    named = classes.join(classes.groupBy(F.col("component").alias("c")).agg(F.min("least").alias("all")), F.col("component") == F.col("c")).select(F.col("key").alias("k"), "all")
    out = attach(rows, named, F.col("key") == F.col("k"), "left").withColumn("s", F.coalesce("all", "id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("s") < LAST, F.col("s")).alias("component_id"))
