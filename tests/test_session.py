import pytest

from cairnlight.session import broadcast_if_small, dropped, shared_folder, spread, stored, stored_bytes


def test_spread_only_what_is_read_in_few_splits(spark, tmp_path):
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    spark.range(100).coalesce(1).write.parquet(one)
    spark.range(100).repartition(9).write.parquet(many)
    assert spread(spark.read.parquet(one)).rdd.getNumPartitions() == 4
    assert "Exchange" not in spread(spark.read.parquet(many))._jdf.queryExecution().executedPlan().toString()
    assert spread(spark.range(5)).count() == 5


def test_stored_frames_live_in_the_shared_folder(spark):
    df = stored(spark.range(10).withColumnRenamed("id", "x"), "t")
    files = df.inputFiles()
    assert df.count() == 10 and all(shared_folder(spark) in f for f in files)
    dropped(df)
    assert stored(spark.range(0), "t").count() == 0


def test_broadcast_needs_a_known_size(spark):
    df = stored(spark.range(100), "t")
    assert "broadcast" in broadcast_if_small(df)._jdf.queryExecution().logical().toString().lower()
    assert 0 < stored_bytes(df) < 1 << 20 and broadcast_if_small(df, most=9) is df
    with pytest.raises(ValueError, match="stored"):
        broadcast_if_small(spark.range(3))
