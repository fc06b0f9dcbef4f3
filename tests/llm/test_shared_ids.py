"""Rows that share an id, or have none, are still linked by their own texts only."""

import collections

import corpus_pipeline
from thicket.llm import setsketch

from .test_operators import near


def text(name, changed=()):
    return " ".join(f"x{i}" if i in changed else f"{name}{i}" for i in range(80))


#: Sorted by id, null last. Null ids: near 5, near 9, near each other only, and near nothing; id 7: near 3, and near nothing.
ROWS = [(3, text("a")), (5, text("b")), (7, text("a", [40])), (7, text("c")), (8, text("d")), (8, text("d")), (8, text("d", [20])), (9, text("e"))]
ROWS += [(None, t) for t in (text("b", [40]), text("e", [3]), text("f"), text("f", [79]), text("f"), text("g"), None, "", None)]


def want(width, percent):
    """``doc_id, n_shingles, component_id`` of each row, by place as node, and the groups of places."""
    got = near(list(enumerate(t for _, t in ROWS)), width, percent)
    groups = collections.defaultdict(list)
    for k, _, c, _ in got:
        groups[c].append(k)
    return [(ROWS[k][0], n, ROWS[c][0]) for k, n, c, _ in got], list(groups.values())


def by_text(rows):
    return collections.Counter(map(tuple, rows))


def test_groups_of_shared_ids(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    out = setsketch.near_groups(d).collect()
    rows, groups = want(3, 85)
    assert by_text(r[:3] for r in out) == by_text(rows)
    assert by_text([r["doc_id"]] for r in out if r["kept"]) == by_text([ROWS[g[0]][0]] for g in groups)


def test_pipeline_keeps_one_of_each_group(spark):
    d = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(ROWS)], "doc_id long, text string, place int").repartition(3)
    left = {r["place"] for r in corpus_pipeline.near_duplicates(spark, d, "").collect()}
    for g in want(5, 80)[1]:
        assert len(left & set(g)) == 1
        assert ROWS[min(left & set(g))][0] == ROWS[g[0]][0]
