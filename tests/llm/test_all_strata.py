"""No stratum goes without its cutoffs because there are many."""

from thicket.llm import quality_rules


def test_every_stratum_takes_its_steps(spark):
    rows = [(s, None) for s in [*map(str, range(1200)), None] for _ in range(550)]
    got = quality_rules.furthest(spark.createDataFrame(rows, "stratum string, step int"), 3, 0.02, 0.05)
    assert got.filter("taken = 3").count() == 1201


def test_every_stratum_is_judged(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good, ("a", None)[i % 2]) for i in range(800)] + [(9000 + i, good + " #" * 30, ("a", None)[i % 2]) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.filter("doc_id < 800").selectExpr("doc_id", "1 as quality", "0 as toxic")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, labels).collect()}
    assert got[0] and got[1] and not got[9000] and not got[9001]
