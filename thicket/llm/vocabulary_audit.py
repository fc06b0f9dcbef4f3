"""How sources of a language differ in the words they use.

The first pass over the texts counts exactly in how many documents of a language each
term stands; those in enough documents are its vocabulary. The second pass recounts
their occurrences with an automaton over the kept terms, each padded with delimiters, so
that only whole terms match.

An automaton in each task has room for a bounded number of terms: the most frequent
ones. Words that it doesn't know are few; they go, as delimited text, to the range of
the vocabulary that their hash says, and there an automaton over that range's terms
counts them in the same way. So no task holds the whole vocabulary, however large.

Counts are sparse postings, a row a term and source that has it. What terms with a count
of 0 add to a pair of sources depends on both sources' sizes alone, so a pair's value is
a sum over common postings and over each source's histogram of counts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import filterfalse
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.llm.shared import attach, batches, shared_table, small_batches

#: ASCII letters in lower case and bytes of other characters stay; all else is a delimiter.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Documents of a language in which a term must stand; parts of a whole; ranks of terms that are returned.
LEAST_DOCUMENTS, WHOLE, RANKS = 3, 1_000_000_000, 200
#: Terms that the automaton of every task knows at most, and their bytes at most; terms of a range, on average.
HEAD_TERMS, TERM_BYTES, RANGE_TERMS = 40_000, 64, 50_000
#: Counts, and matches, that a task holds before it sends them on, characters that an automaton reads at once, and pairs of postings.
HELD, MATCHES, TEXT_CHARS, PAIRS = 400_000, 6_000_000, 1 << 22, 1 << 20
#: Bits of a term's number that lie within a block of counts; where the numbers of terms outside the head start.
BLOCK_BITS, TAIL = 12, 1 << 40
#: Sources of a language that are compared as a block, and pairs of sources whose sums a task holds as a matrix.
SOURCES, MATRIX = 1024, 1 << 20

COUNT_SQL = "tid long, lang string, source string, n long"
#: Counts of a block of terms in a source: places in the block, and counts.
BLOCKS = pa.schema([("kind", pa.int32()), ("range", pa.int64()), ("lang", pa.string()), ("source", pa.string()), ("block", pa.int64()), ("places", pa.binary()), ("counts", pa.binary()), ("text", pa.binary())])
BLOCK_SQL = "kind int, range long, lang string, source string, block long, places binary, counts binary, text binary"


def delimited(text: bytes) -> bytes:
    """The text's terms with delimiters around them."""
    return b" " + text.translate(LETTERS) + b" "


def texts(docs: DataFrame) -> DataFrame:
    """``lang, source, text`` as bytes; nulls are empty."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def document_frequencies(plain: DataFrame) -> DataFrame:
    """``lang, term, df``: in how many documents of its language each term stands."""
    schema = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("df", pa.int64())])

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[str, Counter] = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, c in held.items():
                terms, n = list(c.keys()), list(c.values())
                for i in range(0, len(terms), 20_000):
                    some = terms[i : i + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()), pa.array(n[i : i + 20_000], pa.int64())], schema=schema)
            held.clear()

        for batch in parts:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held[lang].update(set(text.translate(LETTERS).split()))
            if sum(map(len, held.values())) > HELD:
                yield from flush()
        yield from flush()

    got = plain.select("lang", "text").mapInArrow(rows, "lang string, term binary, df long")
    return got.groupBy("lang", "term").agg(F.sum("df").alias("df"))


def automaton(terms: Iterable[tuple[bytes, int]]) -> ahocorasick.Automaton | None:
    """Finds the terms with their delimiters; a match's value is the term's number."""
    a = ahocorasick.Automaton()
    for term, tid in terms:
        a.add_word(f" {spelled(term)} ", tid)
    if not len(a):
        return None
    a.make_automaton()
    return a


def spelled(text: bytes) -> str:
    """Bytes as characters, the same for the same bytes even where they are no valid UTF-8."""
    return text.decode("utf-8", "surrogateescape")


def matches(a: ahocorasick.Automaton, text: bytes) -> np.ndarray:
    """The numbers of the terms that stand in a delimited text, once an occurrence."""
    return np.fromiter(map(itemgetter(1), a.iter(spelled(text))), np.int64)


def blocks_of(kind: int, lang: str, source: str, tids: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
    """Rows of BLOCKS for counts of terms in ascending order."""
    block = tids >> BLOCK_BITS
    cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(tids) else np.zeros(1, int)
    places, counts = (tids & ((1 << BLOCK_BITS) - 1)).astype(np.uint16), counts.astype(np.int64)
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield kind, None, lang, source, int(block[i]), places[i:j].tobytes(), counts[i:j].tobytes(), None


class Found:
    """Matches by language and source, until there are many."""

    def __init__(self) -> None:
        self.held: defaultdict[tuple[str, str], list[np.ndarray]] = defaultdict(list)
        self.size = 0

    def add(self, lang: str, source: str, tids: np.ndarray) -> None:
        self.held[lang, source].append(tids)
        self.size += len(tids)

    def flush(self, kind: int) -> Iterator[tuple]:
        for (lang, source), some in self.held.items():
            yield from blocks_of(kind, lang, source, *np.unique(np.concatenate(some), return_counts=True))
        self.held.clear()
        self.size = 0


def merged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of COUNT_SQL from rows ``block, lang, source, places, counts`` that are sorted by the first three."""
    at, total, made = None, np.zeros(1 << BLOCK_BITS, np.int64), []

    def close() -> None:
        some = np.flatnonzero(total)
        made.append((at, some + (at[0] << BLOCK_BITS), total[some]))
        total[:] = 0

    def batch_of() -> pa.RecordBatch:
        sizes = [len(m[1]) for m in made]
        name = lambda i: pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(made), dtype=np.int32), sizes)), pa.array([m[0][i] for m in made], pa.string())).cast(pa.string())
        out = pa.RecordBatch.from_arrays([pa.array(np.concatenate([m[1] for m in made])), name(1), name(2), pa.array(np.concatenate([m[2] for m in made]))], ["tid", "lang", "source", "n"])
        made.clear()
        return out

    for batch in parts:
        for *key, places, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "lang", "source", "places", "counts")), strict=True):
            if key != at and at is not None:
                close()
                if len(made) >= 50:
                    yield batch_of()
            at = key
            np.add.at(total, np.frombuffer(places, np.uint16), np.frombuffer(counts, np.int64))
    if at is not None:
        close()
    if made:
        yield batch_of()


def range_of(seed: int, term: bytes, ranges: int) -> int:
    """As Spark's pmod(xxhash64(lang, term), ranges), for the ``seed`` of the language."""
    h = xxhash.xxh64_intdigest(term, seed)
    return (h - (h >> 63 << 64)) % ranges


def numbered_terms(found: DataFrame, scope: str) -> tuple[DataFrame, int]:
    """A shared table ``tid, lang, term, df``, and how many terms lie outside the head.

    The head is all short terms above the least step of df (16 steps a doubling) that leaves
    HEAD_TERMS of them at most; its numbers start at 0, by language, the others' at TAIL.
    """
    step = F.floor(16 * F.log2(F.col("df").cast("double"))).cast("int")
    short = (F.octet_length("term") <= TERM_BYTES) & (F.octet_length("lang") <= TERM_BYTES)
    steps = found.groupBy(F.when(short, step).otherwise(-1).alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()  # 1,024 rows at most
    total, cut = 0, None
    for r in sorted(steps, key=lambda r: -r["step"]):
        if r["step"] < 0 or total + r["n"] > HEAD_TERMS:
            break
        total, cut = total + r["n"], r["step"]
    inside = short & (step >= cut) if cut is not None else F.lit(False)
    order = [F.monotonically_increasing_id().alias("tid"), "lang", "term", "df"]
    head = found.filter(inside).coalesce(1).sortWithinPartitions("lang", "term").select(*order)  # HEAD_TERMS at most
    tail = found.filter(~inside).select(*order).withColumn("tid", F.col("tid") + TAIL)
    return shared_table(head.unionByName(tail), "vocabulary-terms", scope), sum(r["n"] for r in steps) - total


def recounted(plain: DataFrame, vocabulary: DataFrame, rest: int, scope: str) -> DataFrame:
    """``tid, lang, source, n``: occurrences of kept terms, by source.

    ``vocabulary``: ``tid, lang, term, df``, of which ``rest`` lie outside the head.
    """
    spark = plain.sparkSession
    ranges = max(1, -(-rest // RANGE_TERMS))
    head = defaultdict(list)
    for r in vocabulary.filter(F.col("tid") < TAIL).select("lang", "term", "tid").collect():  # HEAD_TERMS at most
        head[r["lang"]].append((bytes(r["term"]), r["tid"]))
    sent = spark.sparkContext.broadcast(dict(head))

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Counts of head terms (kind 0), and delimited text of other words by range (kind 2)."""
        machines, found = Machines(sent.value), Found()
        other: defaultdict[tuple[int, str, str], list[bytes]] = defaultdict(list)
        held = 0

        def flush() -> Iterator[tuple]:
            yield from found.flush(0)
            for (r, lang, source), words in other.items():
                yield 2, r, lang, source, None, None, None, b" " + b" ".join(words) + b" "
            other.clear()

        for batch in parts:
            by: defaultdict[tuple[str, str], list[bytes]] = defaultdict(list)
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                by[lang, source].append(delimited(text))
            for (lang, source), some in by.items():
                machine, known = machines[lang]
                seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogateescape"), 42)
                for text in pieces(some):
                    if machine:
                        found.add(lang, source, matches(machine, text))
                    if rest:
                        for w in filterfalse(known.__contains__, text.split()):
                            other[range_of(seed, w, ranges), lang, source].append(w)
                            held += 1
            if held > HELD or found.size > MATCHES:
                yield from flush()
                held = 0
        yield from flush()

    first = plain.mapInArrow(lambda p: batches(scan(p), BLOCKS, 500), BLOCK_SQL)
    if rest:
        first = shared_table(first, "vocabulary-scan", scope)
        terms = vocabulary.filter(F.col("tid") >= TAIL).select(
            F.lit(1).alias("kind"), F.pmod(F.xxhash64("lang", "term"), F.lit(ranges)).cast("long").alias("range"), "lang", F.lit("").alias("source"), F.col("tid").alias("block"), F.lit(None).cast("binary").alias("places"), F.lit(None).cast("binary").alias("counts"), F.col("term").alias("text")
        )
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranged = terms.unionByName(first.filter("kind = 2")).repartition(max(n, ranges), "range").sortWithinPartitions("range", "kind")

        def finish(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            at, terms, found = None, defaultdict(list), Found()
            machines = Machines(terms)
            for batch in parts:
                for kind, r, lang, source, tid, text in zip(*(batch.column(c).to_pylist() for c in ("kind", "range", "lang", "source", "block", "text")), strict=True):
                    if r != at:
                        yield from found.flush(0)
                        at, terms = r, defaultdict(list)
                        machines = Machines(terms)
                    if kind == 1:
                        terms[lang].append((text, tid))
                    elif machine := machines[lang][0]:
                        found.add(lang, source, matches(machine, text))
                if found.size > MATCHES:
                    yield from found.flush(0)
            yield from found.flush(0)

        tail = ranged.mapInArrow(lambda p: batches(finish(p), BLOCKS, 500), BLOCK_SQL)
        first = first.filter("kind = 0").unionByName(tail)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_block = first.select("block", "lang", "source", "places", "counts").repartition(n, "block", "lang", "source").sortWithinPartitions("block", "lang", "source")
    return by_block.mapInArrow(merged, COUNT_SQL)


class Machines(dict):
    """By language the automaton over its terms, made when first asked for, and the terms."""

    def __init__(self, terms: dict[str, list[tuple[bytes, int]]]) -> None:
        self.terms = terms

    def __missing__(self, lang: str) -> tuple[ahocorasick.Automaton | None, frozenset[bytes]]:
        own = self.terms.get(lang, [])
        self[lang] = made = automaton(own), frozenset(t for t, _ in own)
        return made


def pieces(some: list[bytes]) -> Iterator[bytes]:
    """The texts joined, in pieces of about TEXT_CHARS; a text is in one piece."""
    held, size = [], 0
    for text in some:
        held.append(text)
        size += len(text)
        if size >= TEXT_CHARS:
            yield b"".join(held)
            held, size = [], 0
    if held:
        yield b"".join(held)


def share(n: Column, total: Column) -> Column:
    """1 + floor(WHOLE * (n + 1) / total), exactly."""
    whole = F.expr(f"cast({WHOLE} as decimal(20,0))")
    return (F.lit(1) + F.when(n < 9_000_000_000, F.call_function("div", (n + 1) * WHOLE, total)).otherwise(F.call_function("div", ((n + 1).cast("decimal(18,0)") * whole), total.cast("decimal(18,0)")))).cast("long")


def gap(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def common(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """From postings ``tid, lang, gid, p, z, sources`` sorted by tid the rows ``lang, a, b, value``: what terms
    that both sources have add to a pair, beyond what they would as terms of one or neither."""
    dense: dict[str, np.ndarray] = {}  # by language, of few sources: sums of pairs
    sparse: defaultdict[str, Counter] = defaultdict(Counter)
    kept: list[tuple[np.ndarray, ...]] = []
    names: dict[str, int] = {}
    widths: list[int] = []

    def add(tid: np.ndarray, lang: np.ndarray, gid: np.ndarray, p: np.ndarray, z: np.ndarray) -> None:
        start = np.flatnonzero(np.concatenate([[True], tid[1:] != tid[:-1]]))
        size = np.diff(np.concatenate([start, [len(tid)]]))
        own, first = np.repeat(size, size), np.repeat(start, size)  # each posting meets all of its term's
        upto, done = np.cumsum(own), 0
        while done < len(tid):
            stop = max(done + 1, int(np.searchsorted(upto, PAIRS + (upto[done - 1] if done else 0), "right")))
            k = own[done:stop]
            i = np.repeat(np.arange(done, stop), k)
            j = np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k) + first[i]
            i, j = i[i != j], j[i != j]
            v = gaps(p[i], p[j]) - gaps(p[i], z[j]) - gaps(z[i], p[j]) + gaps(z[i], z[j])
            for name, code in names.items():
                m, width = lang[i] == code, widths[code]
                if not m.any():
                    continue
                a, b = gid[i[m]], gid[j[m]]
                if width * width <= MATRIX:
                    np.add.at(dense.setdefault(name, np.zeros(width * width, np.int64)), a * width + b, v[m])
                    continue
                pair, where = np.unique(np.column_stack([a, b]), axis=0, return_inverse=True)
                total = np.zeros(len(pair), np.int64)
                np.add.at(total, where.ravel(), v[m])
                for (x, y), t in zip(pair.tolist(), total.tolist(), strict=True):
                    sparse[name][x, y] += t
            done = stop

    def flush() -> Iterator[tuple]:
        for name, c in sparse.items():
            for (a, b), v in c.items():
                yield name, a, b, v
        sparse.clear()
        for name, sums in dense.items():
            for i in np.flatnonzero(sums).tolist():
                yield name, *divmod(i, widths[names[name]]), int(sums[i])
        dense.clear()

    for batch in parts:
        if not batch.num_rows:
            continue
        tid, gid, p, z, width = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tid", "gid", "p", "z", "sources"))
        coded = batch.column("lang").dictionary_encode()
        place = coded.indices.to_numpy(zero_copy_only=False)
        for i, name in enumerate(coded.dictionary.to_pylist()):
            if name not in names:
                names[name] = len(widths)
                widths.append(int(width[np.flatnonzero(place == i)[0]]))
        kept.append((tid, np.array([names[x] for x in coded.dictionary.to_pylist()])[place], gid, p, z))
        # All but the last term, whose postings may go on.
        if kept[0][0][0] != tid[-1]:
            cols = [np.concatenate([k[i] for k in kept]) for i in range(5)]
            cut = int(np.searchsorted(cols[0], tid[-1]))
            add(*(c[:cut] for c in cols))
            kept = [tuple(c[cut:] for c in cols)]
        if sum(map(len, sparse.values())) > HELD or len(dense) > 16:
            yield from flush()
    if kept:
        add(*(np.concatenate([k[i] for k in kept]) for i in range(5)))
    yield from flush()


def single(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows ``lang, a, b, value`` of what terms add as those of one source or of neither, from each
    source's histogram ``gid, z, kinds, counts`` (p of its terms, how many) against a block of the language's sources."""
    for batch in parts:
        for lang, v, gid, z, have, p, m, others in zip(*(batch.column(c).to_pylist() for c in ("lang", "v", "gid", "z", "have", "p", "m", "others")), strict=True):
            others = [o for o in others if o["gid"] != gid]
            if not others:
                continue
            q, there = (np.array([o[c] for o in others], np.int64) for c in ("z", "have"))
            p, m = np.array(p or [], np.int64), np.array(m or [], np.int64)
            one, two = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
            for at in range(0, len(p), 4096):
                x, k = p[at : at + 4096, None], m[at : at + 4096, None]
                one += (gaps(x, q[None]) * k).sum(0)
                two += (gaps(q[None], x) * k).sum(0)
            one += (v - have - there) * gaps(np.full(len(q), z), q) if v else 0
            for o, x, y in zip(others, one.tolist(), two.tolist(), strict=True):
                yield lang, gid, o["gid"], x
                yield lang, o["gid"], gid, y


PAIR_SQL = "lang string, a long, b long, value long"
PAIR_SCHEMA = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64())])


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = RANKS, scope: str = "") -> DataFrame:
    """How each source of a language differs from its other sources and from the whole language.

    Returns ``lang, source, part, item, value, rank``. Terms are runs of ASCII letters, in
    lower case, and of characters beyond ASCII; a language keeps those that stand in at
    least ``least`` of its documents. A source's share of a kept term is
    p = 1 + floor(1e9 * (count + 1) / (N + V)), with N the source's occurrences of all V
    kept terms; the language's is the same of all its documents. A difference is
    floor((p - q) ** 2 / q). Part ``pair``: for each other source its p as q, summed over
    all kept terms. Part ``term``: each kept term that the source has and uses more than
    its language does, with the language's p as q, the first ``ranks`` of them. Ranks go
    from 1 by falling value, then by the item's UTF-8 bytes. All arithmetic is exact.

    Null text, lang and source are empty; a source without terms, or whose language keeps
    none, has its pairs too (0 if nothing is kept). Very long texts are read whole, as are
    very long terms. Repeated rows are documents of their own. An empty table gives an
    empty result. doc_id isn't read; other columns are ignored.
    """
    small_batches(docs.sparkSession, 1000)
    plain = texts(docs)
    found = shared_table(document_frequencies(plain).filter(F.col("df") >= least), "vocabulary", scope)
    vocabulary, rest = numbered_terms(found, scope)
    counts = shared_table(recounted(plain, vocabulary, rest, scope), "vocabulary-counts", scope)

    # A row a source: its number within the language, N, the number of kept terms, and the share of a term it doesn't have.
    every = plain.select("lang", "source").distinct()
    sizes = counts.groupBy(F.col("lang").alias("l"), F.col("source").alias("s")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("have"))
    kept = vocabulary.groupBy(F.col("lang").alias("kl")).agg(F.count(F.lit(1)).alias("v"))
    groups = every.join(sizes, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")), "left").join(kept, F.col("lang") == F.col("kl"), "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "have", "v")])
    groups = groups.withColumn("gid", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")).withColumn("sources", F.count(F.lit(1)).over(Window.partitionBy("lang")))
    z = F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.greatest(F.col("total") + F.col("v"), F.lit(1)))).otherwise(1)
    groups = shared_table(groups.withColumn("z", z.cast("long")), "vocabulary-groups", scope)

    # Postings with both shares, in order of the term.
    side = groups.select(F.col("lang").alias("gl"), F.col("source").alias("gs"), "gid", (F.col("total") + F.col("v")).alias("size"), "z", "sources")
    posted = attach(counts, side, (F.col("lang") == F.col("gl")) & (F.col("source") == F.col("gs"))).select("tid", "lang", "gid", "n", share(F.col("n"), F.col("size")).alias("p"), "z", "sources")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = posted.select("tid", "lang", "gid", "p", "z", "sources").repartition(n, "tid").sortWithinPartitions("tid").mapInArrow(lambda p: batches(common(p), PAIR_SCHEMA), PAIR_SQL)

    shapes = posted.groupBy("lang", "gid", "p").agg(F.count(F.lit(1)).alias("m")).groupBy(F.col("lang").alias("hl"), F.col("gid").alias("hg")).agg(F.collect_list("p").alias("p"), F.collect_list("m").alias("m"))
    own = groups.join(shapes, (F.col("lang") == F.col("hl")) & (F.col("gid") == F.col("hg")), "left").select("lang", "v", "gid", "z", "have", "p", "m")
    blocks = groups.groupBy(F.col("lang").alias("bl"), F.floor(F.col("gid") / SOURCES).alias("block")).agg(F.collect_list(F.struct("gid", "z", "have")).alias("others"))  # SOURCES at most
    alone = own.join(blocks, F.col("lang") == F.col("bl")).select("lang", "v", "gid", "z", "have", "p", "m", "others").mapInArrow(lambda p: batches(single(p), PAIR_SCHEMA), PAIR_SQL)
    pairs = both.unionByName(alone).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    for side_, name in (("a", "source"), ("b", "item")):
        names = groups.select(F.col("lang").alias("nl"), F.col("gid").alias("ng"), F.col("source").alias(name))
        pairs = attach(pairs, names, (F.col("lang") == F.col("nl")) & (F.col(side_) == F.col("ng"))).drop("nl", "ng")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order).cast("int"))

    whole = attach(counts.groupBy("lang").agg(F.sum("n").alias("all")), kept, F.col("lang") == F.col("kl")).select(F.col("lang").alias("wl"), (F.col("all") + F.col("v")).alias("size"))
    told = posted.withColumn("sum", F.sum("n").over(Window.partitionBy("tid")))
    told = attach(told, whole, F.col("lang") == F.col("wl")).withColumn("q", share(F.col("sum"), F.col("size"))).filter("p > q").select("tid", "lang", "gid", gap(F.col("p"), F.col("q")).alias("value"))
    told = told.join(vocabulary.select(F.col("tid").alias("vt"), F.col("term").cast("string").alias("item")), F.col("tid") == F.col("vt"))
    best = Window.partitionBy("lang", "gid").orderBy(F.desc("value"), "item")
    told = told.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= ranks)
    names = groups.select(F.col("lang").alias("nl"), F.col("gid").alias("ng"), "source")
    told = attach(told, names, (F.col("lang") == F.col("nl")) & (F.col("gid") == F.col("ng")))
    return pairs.unionByName(told.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


#: What a share is made of in SQL: counts ``n`` of a group of ``total`` and ``v`` kept terms.
_P = "1 + (1000000000::hugeint * (n + 1)) // (total + v)"


def sql(least: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') as text from documents),
t as materialized (select id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
k as materialized (select lang, term from t group by all having count(distinct id) >= {least}),
g as (select lang, source, coalesce(v, 0) as v from (select distinct lang, source from d) left join (select lang, count(*) as v from k group by lang) using (lang)),
c as materialized (select lang, source, term, count(*) as n from t join k using (lang, term) group by all),
gk as (select lang, source, v, term, coalesce(n, 0) as n from g join k using (lang) left join c using (lang, source, term)),
gp as materialized (select lang, source, term, n, {_P} as p from (select *, sum(n) over (partition by lang, source) as total from gk)),
lp as (select lang, term, {_P} as q from (select *, sum(n) over (partition by lang) as total, count(*) over (partition by lang) as v from (select lang, term, sum(n) as n from c group by all))),
pv as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from gp a join gp b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pr as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pv on pv.lang = a.lang and pv.source = a.source and pv.item = b.source),
tm as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // q)::bigint as value from gp join lp using (lang, term) where n > 0 and p > q)
select lang, source, part, item, value, rank from (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from (select * from pr union all select * from tm)) where part = 'pair' or rank <= {ranks}"""
