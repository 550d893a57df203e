from pyspark.sql import functions as F

from lamina.operators.patches import batches
from lamina.operators.ranking import numbered


def test_numbers_follow_the_order(spark):
    rows = [(i, (i * 7919) % 1000, "x" if i % 3 else None) for i in range(3000)] + [(9999, 5, "y")] * 40
    df = spark.createDataFrame(rows, "id int, v int, s string").repartition(5)
    got = numbered(df, F.desc("v"), F.col("id"), start=1).collect()
    assert sorted(r["n"] for r in got) == list(range(1, 3041))
    by = [(-r["v"], r["id"]) for r in sorted(got, key=lambda r: r["n"])]
    assert by == sorted(by)
    one = numbered(df, "s").collect()
    assert sorted(r["n"] for r in one) == list(range(3040))
    assert all(r["s"] is None for r in one if r["n"] < 1000)
    assert numbered(df.limit(0), "v").count() == 0


def test_batches_hold_each_row_once(spark):
    df = spark.range(101).withColumnRenamed("id", "k")
    got = batches(df, 10, 3, "k").collect()
    assert sorted(r["k"] for r in got) == list(range(101))
    assert sorted(r["batch"] for r in got) == [i // 10 for i in range(101)]
    assert batches(df, 10, 3, "k", drop_last=True).count() == 100
    assert {tuple(r) for r in batches(df, 10, 3, "k").collect()} == {tuple(r) for r in got}
