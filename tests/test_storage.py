"""Tables that a query stores between its steps."""

from pyspark.sql import functions as F

from shelfmark.plans.storage import stored


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_large_tables_of_few_values_are_not_broadcast(spark):
    many = spark.range(400_000).select(F.col("id").alias("k"), *(F.lit("the same long text in each row").alias(f"c{i}") for i in range(4)))
    kept = stored(many, "many")
    found = kept.join(spark.range(500_000).select(F.col("id").alias("k")), "k")
    assert "BroadcastHashJoin" not in plan(found) and "SortMergeJoin" in plan(found)
    assert found.count() == 400_000


def test_small_and_empty_tables_are_as_before(spark):
    few = stored(spark.range(100).select(F.col("id").alias("k")), "few")
    assert "BroadcastHashJoin" in plan(few.join(spark.range(500_000).select(F.col("id").alias("k")), "k"))
    assert stored(few.where("k < 0"), "none").isEmpty()
