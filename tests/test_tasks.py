from strideway.sources import network


def test_more_input_makes_more_tasks(spark, tmp_path, monkeypatch):
    keys = ["spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        path = str(tmp_path / "t")
        spark.range(100_000).write.parquet(path)
        monkeypatch.setattr(network, "SHUFFLED", 8 << 10)
        network.bounded_tasks(spark, path)
        assert int(spark.conf.get(keys[0])) > 50
        assert int(spark.conf.get(keys[1])) == network.SPLIT
        spark.conf.set(keys[1], "1m")
        network.bounded_tasks(spark, path)
        assert spark.conf.get(keys[1]) == "1m"
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
