"""A small forest whose answers can be worked out by hand."""

from pyspark.sql import DataFrame, SparkSession

from thicket.operators import forest

#: Two trees: (tree, node, parent, depth, side, split feature, split value, samples, medians, dispersions) over two outputs.
OUTPUTS = ["quantity", "extendedprice"]
TREES = [
    (1, "RT", None, 0, None, "discount", 0.05, ["1", "2", "3", "4", "5", "6"], [25.0, 36000.0], [12.0, 17000.0]),
    (1, "RTL", "RT", 1, "L", None, None, ["1", "2", "3"], [20.0, 30000.0], [8.0, 9000.0]),
    (1, "RTR", "RT", 1, "R", "tax", 0.04, ["4", "5", "6"], [28.0, 40000.0], [10.0, 15000.0]),
    (1, "RTRL", "RTR", 2, "L", None, None, ["4", "5"], [24.0, 35000.0], [0.0, 5000.0]),
    (1, "RTRR", "RTR", 2, "R", None, None, ["6"], [33.0, 45000.0], [7.0, 12000.0]),
    (2, "RT", None, 0, None, "quantity", 25.0, ["2", "3", "4", "5", "6", "7"], [26.0, 35000.0], [13.0, 16000.0]),
    (2, "RTL", "RT", 1, "L", "discount", 0.03, ["2", "3", "4"], [12.0, 18000.0], [6.0, 8000.0]),
    (2, "RTR", "RT", 1, "R", None, None, ["5", "6", "7"], [38.0, 52000.0], [6.0, 20000.0]),
    (2, "RTLL", "RTL", 2, "L", None, None, ["2"], [10.0, 15000.0], [5.0, 4000.0]),
    (2, "RTLR", "RTL", 2, "R", None, None, ["3", "4"], [14.0, 21000.0], [4.0, 6000.0]),
]


def trees(spark: SparkSession) -> DataFrame:
    rows = [(t, 0, n, p, depth, side, f, v, f is None, len(s), s, OUTPUTS, m, x, [1.0, 1.0], None, None) for t, n, p, depth, side, f, v, s, m, x in TREES]
    return forest.with_gains(spark.createDataFrame(rows, forest.NODE_SQL))
