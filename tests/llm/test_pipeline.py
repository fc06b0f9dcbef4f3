"""Each stage of the pipeline against what it must keep, on the smallest tables."""

import collections

import corpus_pipeline
from thicket.llm import mixing, ordinal, packing, pii

from .test_operators import near

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], DIR).write.parquet(str(tmp_path / str(i)))
        seen.append(spark.read.parquet(str(tmp_path / str(i))))
    raw, graded, unique, clean, mixed, packed = seen
    for stage in (graded, unique, clean, mixed):
        assert stage.dtypes == docs.dtypes
    assert 0 < graded.count() <= raw.count() and graded.exceptAll(raw).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in graded.collect()]
    assert {r["doc_id"] for r in unique.collect()} == {i for i, _, _, kept in near(rows, 5, 80) if kept}
    before = {r["doc_id"]: r["text"] for r in unique.collect()}
    for r in clean.collect():
        assert pii.base_spans(r["text"]) == [] and r["n_chars"] == len(r["text"])
        assert pii.base_spans(before[r["doc_id"]]) or r["text"].count("[") >= before[r["doc_id"]].count("[")
    copies = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert max(copies.values()) <= 3 and set(copies) <= {r["doc_id"] for r in clean.collect()}
    memo = packing.memo_of(corpus_pipeline.tokenizer_path("word_bpe_49k.json"), "<u2")
    want = sum(len(memo.whole(r["text"])) // 2 + 1 for r in mixed.collect())
    pieces = packed.collect()
    assert sum(p["length"] for p in pieces) == want and all(p["ids_crc32"] >= 0 for p in pieces)


def test_run(spark):
    import os

    assert corpus_pipeline.run(spark, DIR).count() > 0
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert [x for x in os.listdir(root) if x.startswith("pipeline-")] and not [x for x in os.listdir(root) if x.startswith("pipeline-") and not x.startswith("pipeline-4")]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "near duplicates", "personal data", "mixture", "packing"]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, gone long, gone_t long, t string, copy boolean, row string, s string, key string, mix_hash long, mix_text string, copies int, size int"
GOOD = " ".join(f"good{i}" for i in range(60))
MAIL = "write to some.one@example.org or call +1 (269) 555-3296 " + " ".join(f"mail{i}" for i in range(30))


def odd_tables(spark, where):
    rows = [(1, GOOD), (2, GOOD), (2, GOOD), (3, None), (4, ""), (5, " \n"), (None, GOOD + " tail"), (None, "other " + MAIL), (None, None), (6, MAIL), (7, "long " * 20000 + GOOD.upper()), (8, "bad ! ! !"), (8, "another text of the same id " + " ".join(f"n{i}" for i in range(40))), (9, "é😀 " * 30)]
    full = [(i, t, ("en", None)[k % 2], ("a", None, "b")[k % 3], None if t is None else len(t), 5, 6, "t", True, "r", "s", "k", 7, "m", 8, 9) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(full, COLUMNS).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 1, None), (8, 0, 0), (None, 0, 1), (99, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")


def test_odd_rows_pass_every_stage(spark, tmp_path):
    odd_tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    every = docs.collect()
    ids = lambda df: collections.Counter((r["doc_id"], r["text"]) for r in df.collect())
    kept = corpus_pipeline.classify(spark, docs, str(tmp_path))
    assert kept.dtypes == docs.dtypes and not ids(kept) - ids(docs)
    grades = ordinal.graded(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(r["doc_id"] for r in grades.filter("kept").collect())
    unique = corpus_pipeline.near_duplicates(spark, docs, "")
    assert unique.dtypes == docs.dtypes
    groups = collections.defaultdict(list)
    for k, _, c, _ in near([(k, r["text"]) for k, r in enumerate(every)], 5, 80):
        groups[c].append(every[k]["text"])
    left = collections.Counter(r["text"] for r in unique.collect())
    assert sum(left.values()) == len(groups) and all(sum(left[t] for t in set(g)) >= 1 for g in groups.values())
    clean = corpus_pipeline.redact(spark, docs, "")
    assert clean.dtypes == docs.dtypes and clean.count() == docs.count()
    for r in clean.collect():
        assert pii.base_spans(r["text"] or "") == [] and r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    mixed = corpus_pipeline.mix(spark, docs, "")
    assert mixed.dtypes == docs.dtypes
    want = collections.Counter()
    for r in mixing.mix(docs).collect():
        want[r["doc_id"], r["source"]] += r["copies"]
    assert collections.Counter((r["doc_id"], r["source"]) for r in mixed.collect()) == +want
    memo = packing.memo_of(corpus_pipeline.tokenizer_path("word_bpe_49k.json"), "<u2")
    pieces = corpus_pipeline.pack(spark, docs, "").collect()
    assert sum(p["length"] for p in pieces) == sum(len(memo.whole(r["text"] or "")) // 2 + 1 for r in every)
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.dtypes == docs.dtypes)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
