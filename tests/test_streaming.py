from made import put, working

from tallyloom.streaming import ingest


def test_new_files_are_parsed_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", {"a.json": working("a").messages()})

    def go():
        ingest.parse_to(ingest.file_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "at"), once=True).awaitTermination()
        return sorted((r["source"], len(r["actions"])) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert go() == [("claude", 3)]
    put(tmp_path / "in", {"b.json": working("b").stream()})
    assert go() == [("claude", 3), ("codex", 3)]


def test_rates(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("2024-01-01 00:01:00", "view", 1.0), ("2024-01-01 00:09:00", "view", 2.0), ("2024-01-01 00:11:00", "view", 3.0)], "t string, event_type string, value double")
    got = ingest.token_rates(rows.select(F.to_timestamp("t").alias("ts"), "event_type", "value")).orderBy("start").collect()
    assert [(r["n"], r["tokens"]) for r in got] == [(2, 300), (1, 300)]
