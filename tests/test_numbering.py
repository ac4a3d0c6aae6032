from pyspark.sql import functions as F

from tidelog.operators import numbering
from tidelog.operators.numbering import assign_ids, number_rows, number_split_rows, running_total


def skewed(spark):
    """A third of the rows share one key; ``id`` makes the order unique."""
    i = F.col("id")
    key = F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), i % 101))
    return spark.range(0, 9000, 1, 7).select("id", key.alias("key"), (i % 11).alias("n"))


def test_numbers_follow_the_order(spark):
    rows = number_rows(skewed(spark), ["key", F.desc("id")], "no", 5, 16).collect()
    expected = sorted(((r["key"], -r["id"]) for r in rows))
    by_number = sorted(rows, key=lambda r: r["no"])
    assert [(r["key"], -r["id"]) for r in by_number] == expected
    assert [r["no"] for r in by_number] == list(range(5, 9005))


def test_a_hot_key_is_spread_over_partitions(spark):
    placed = skewed(spark).repartitionByRange(12, "key", F.desc("id"))
    sizes = [r[1] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 9000 / 12 * 2


def test_ids_do_not_depend_on_partitioning(spark):
    one = assign_ids(skewed(spark), ["key", "id"], 1, 3)
    other = assign_ids(skewed(spark).withColumnRenamed("id", "src").repartition(5), ["key", "src"], 1, 20)
    assert {tuple(r) for r in one.select("id", "key", "n").collect()} == {
        tuple(r) for r in other.select("id", "key", "n").collect()
    }


def test_running_total(spark):
    rows = running_total(skewed(spark), ["key", "id"], "n", "upto", 9).collect()
    total = 0
    for row in sorted(rows, key=lambda r: (r["key"], r["id"])):
        total += row["n"]
        assert row["upto"] == total


def test_empty_input(spark):
    empty = skewed(spark).limit(0)
    assert number_rows(empty, ["key", "id"], "no").count() == 0
    assert running_total(empty, ["key", "id"], "n", "upto").count() == 0


def test_rows_are_numbered_in_their_splits(spark):
    split = F.floor(F.col("id") / 100)
    rows = spark.range(0, 1000, 1, 4).select("id", (-split).alias("file"))
    rows = rows.filter("id % 3 != 0").withColumn("at", F.monotonically_increasing_id())
    # Two partitions share the split that lies on their border only if a split is cut;
    # 250 rows per partition cut the splits 2 and 7, so those count as two splits each.
    rows = rows.withColumn("part", F.shiftright("at", 33))
    numbered, total = number_split_rows(rows, ["file", "part"], "at")
    found = numbered.orderBy("number").collect()
    assert total == len(found) == 666
    assert [r["number"] for r in found] == list(range(666))
    expected = sorted(found, key=lambda r: (r["file"], r["part"], r["id"]))
    assert [r["id"] for r in found] == [r["id"] for r in expected]


def test_many_totals_are_summed_in_parts(spark, monkeypatch):
    """Both ways of summing the totals give the same offsets, and the same numbers."""
    totals = spark.range(0, 500, 1, 5).select(F.col("id").alias("_part"), (F.col("id") * 7 % 13).alias("_sum"))
    one = {tuple(r) for r in numbering.offsets(totals, ["_part"], "_sum", "_shift", 500).collect()}
    numbers = {tuple(r) for r in number_rows(skewed(spark), ["key", "id"], "no", 5, 12).collect()}
    monkeypatch.setattr(numbering, "WINDOW_ROWS", 8)
    assert {tuple(r) for r in numbering.offsets(totals, ["_part"], "_sum", "_shift", 60).collect()} == one
    assert {tuple(r) for r in number_rows(skewed(spark), ["key", "id"], "no", 5, 12).collect()} == numbers
    assert number_rows(skewed(spark).limit(0), ["key", "id"], "no", 1, 12).count() == 0
