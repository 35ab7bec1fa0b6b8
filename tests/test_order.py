import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwise.operators import ordering, sampling, sequence


def test_positions_are_the_total_order(spark):
    df = spark.range(1000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(50)))
    rows = ordering.ordered_index(df, ["v", "id"], "at").collect()
    assert [r["at"] for r in sorted(rows, key=lambda r: (r["v"], r["id"]))] == list(range(1000))


def test_running_sums(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    rows = sorted(ordering.ordered_running_sums(df, ["k"], {"v": "s"}).collect())
    assert [r["s"] for r in rows] == list(np.cumsum([i % 7 for i in range(500)]))


def test_published_split_sizes(spark):
    """14,655 and 16,827 rows give test sides of 2,931 and 3,366, training 25,185."""
    df = spark.range(14_655 + 16_827).withColumn("y", (F.col("id") >= 14_655).cast("int"))
    cut = {(r["y"], r["split"]): r["count"] for r in sampling.stratified_split(df, "y", "id").groupBy("y", "split").count().collect()}
    assert cut[(0, "test")] == 2931 and cut[(1, "test")] == 3366
    assert cut[(0, "train")] + cut[(1, "train")] == 25_185


def test_split_ignores_partitioning(spark):
    df = spark.range(300).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    one = sorted(tuple(r) for r in sampling.stratified_split(df.repartition(1), "y", "id").select("id", "split").collect())
    many = sorted(tuple(r) for r in sampling.stratified_split(df.repartition(7), "y", "id").select("id", "split").collect())
    assert one == many


def test_single_class_and_tiny_class(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1)], "id int, y int")
    cut = sampling.stratified_split(df, "y", "id").filter("split = 'test'").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in cut} == {0: 1, 1: 1}


def test_labeled_split_parts(spark):
    df = spark.range(100).withColumn("y", F.col("id") % 2)
    parts = sampling.labeled_split(df, "y", "id", 5, validation=10).groupBy("y", "part").count().collect()
    assert {(r["y"], r["part"]): r["count"] for r in parts} == {
        (y, p): n for y in (0, 1) for p, n in (("labeled", 5), ("validation", 10), ("unlabeled", 35))}


def test_permutation_is_one(spark):
    rows = sampling.permuted_pairs(spark.range(200), "id").collect()
    assert sorted(r["id"] for r in rows) == sorted(r["partner"] for r in rows) == list(range(200))


@pytest.mark.parametrize("decay", [0.5, 0.9, 0.999])
def test_ema_over_long_series(spark, decay):
    values = [float((i * 37) % 101) for i in range(3000)]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "s string, t int, v double")
    got = [r["ema"] for r in sorted(sequence.ema_smooth(df, "s", "t", "v", decay).collect(), key=lambda r: r["t"])]
    want = [values[0]]
    for v in values[1:]:
        want.append(decay * want[-1] + (1 - decay) * v)
    assert np.allclose(got, want, rtol=1e-9)


def test_running_best_needs_strictly_more(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate([1.0, 1.0, 2.0, 0.5])], "s string, t int, v double")
    rows = sorted(sequence.running_best(df, "s", "t", "v").collect(), key=lambda r: r["t"])
    assert [r["is_best"] for r in rows] == [True, False, True, False]


def test_best_record_takes_first_on_ties(spark):
    df = spark.createDataFrame([("s", 0, 1.0), ("s", 1, 2.0), ("s", 2, 2.0)], "s string, t int, v double")
    assert [tuple(r) for r in sequence.best_record(df, "s", "t", "v").collect()] == [("s", 1, 2.0)]


def test_smote_balances_on_segments(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=3)], int(i < 12)) for i in range(100)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, y int")
    out = sampling.smote(df, "id", "v", "y", 1).collect()
    assert sum(r["y"] == 1 for r in out) == sum(r["y"] == 0 for r in out) == 88
    few = {i: np.array(v) for i, v, y in rows if y}
    for r in out:
        if r["copy"]:
            start, point = few[r["source_id"]], np.array(r["v"])
            gaps = [np.linalg.norm(point - start) + np.linalg.norm(few[j] - point) - np.linalg.norm(few[j] - start)
                    for j in few if j != r["source_id"]]
            assert min(gaps) < 1e-9


def test_smote_on_balanced_or_single(spark):
    df = spark.createDataFrame([(1, [0.0], 1), (2, [1.0], 0)], "id bigint, v array<double>, y int")
    assert sampling.smote(df, "id", "v", "y", 1).count() == 2
