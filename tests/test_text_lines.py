"""Lines of several files and splits, in order; forests of changed tables."""

from pyspark.sql import functions as F

from thicket import queries
from thicket.sources import text


def test_lines_of_many_files_and_splits(spark, tmp_path):
    want = []
    for name, n in (("b", 700), ("a", 3), ("c", 0), ("d", 1200)):
        (tmp_path / name).write_text("".join(f"{name} {i} {'x' * (i % 50)}\n" if i % 7 else "\n" for i in range(n)))
    for name in "abcd":
        want += (tmp_path / name).read_text().split("\n")[:-1]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = text.lines(spark, str(tmp_path), keep_empty=True)
        assert got.rdd.getNumPartitions() > 4
        assert [(r["pos"], r["value"]) for r in got.orderBy("pos").collect()] == list(enumerate(want))
        assert [r["pos"] for r in text.lines(spark, str(tmp_path)).orderBy("pos").collect()] == [i for i, x in enumerate(want) if x.strip()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_of_an_empty_file(spark, tmp_path):
    (tmp_path / "none").write_text("")
    assert text.lines(spark, str(tmp_path / "none")).count() == 0


def test_a_changed_table_grows_a_new_forest(spark, tmp_path):
    queries.checkpoints(spark)
    customers = spark.range(60).select(F.col("id").alias("c_custkey"), (F.col("id") % 2).alias("c_nationkey"), (F.col("id") * 37 % 23).cast("double").alias("c_acctbal"))
    path = str(tmp_path / "customer.parquet")
    customers.write.parquet(path)
    first = queries.trees(spark, str(tmp_path))
    assert queries.trees(spark, str(tmp_path)) is first
    customers.filter("c_custkey < 40").write.mode("overwrite").parquet(path)
    again = queries.trees(spark, str(tmp_path))
    assert again.filter("depth = 0").agg(F.sum("n_samples")).first()[0] == 40 != first.filter("depth = 0").agg(F.sum("n_samples")).first()[0]
