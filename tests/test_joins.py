from pyspark.sql import functions as F

from tesselade.operators.joins import salted_join


def test_same_as_plain_join(spark):
    left = spark.range(300).select(F.when(F.col("id") % 3 == 0, 0).when(F.col("id") == 1, None).otherwise(F.col("id") % 7).alias("k"), F.col("id").alias("a"))
    right = spark.range(60).select(F.when(F.col("id") == 2, None).otherwise(F.col("id") % 5).alias("k"), F.col("id").alias("b"))
    right = right.union(right.limit(3))
    plain = left.join(right, "k").groupBy("k", "a", "b").count()
    salted = salted_join(left, right, ["k"], 20).groupBy("k", "a", "b").count()
    assert sorted(plain.collect()) == sorted(salted.select(plain.columns).collect())
    assert salted_join(left.limit(0), right, ["k"]).count() == 0
