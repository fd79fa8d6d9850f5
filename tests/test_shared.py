from lexmill.sources import shared


def test_kept_and_sized(spark):
    df = spark.range(100).selectExpr("id", "repeat('x', 1000) AS t", "array(id) AS a")
    assert shared.kept(df).collect() == df.collect()
    small = shared.sized(df)
    assert "broadcast" in small._jdf.queryExecution().analyzed().toString().lower() and small.count() == 100
    large = shared.sized(df, most=10_000)
    assert "broadcast" not in large._jdf.queryExecution().analyzed().toString().lower() and large.count() == 100
    assert shared.sized(df.limit(0)).count() == 0
