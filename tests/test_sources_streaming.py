import json

from pyspark.sql import functions as F

from quarry.sources import readers
from quarry.streaming import windows


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"tool_name": "netscan", "output": {"entries": [{"pid": 4}, {"pid": 8}]}}))
    (tmp_path / "b.json").write_text(json.dumps({"tool_name": "pslist", "output": [{"pid": 1}]}))
    rows = readers.json_records(spark, f"{tmp_path}/*.json").orderBy("tool", "record_index").collect()
    assert [(r.tool, r.record_index, json.loads(r.raw)) for r in rows] == [("netscan", 0, {"pid": 4}), ("netscan", 1, {"pid": 8}), ("pslist", 0, {"pid": 1})]
    (tmp_path / "c.csv").write_text('name,size\n"a ""b""",3\n')
    assert [tuple(r) for r in readers.csv_records(spark, f"{tmp_path}/c.csv").collect()] == [('a "b"', "3")]
    (tmp_path / "d.xml").write_text("<all><row><id>1</id></row><row><id>2</id></row></all>")
    assert sorted(r.id for r in readers.xml_records(spark, f"{tmp_path}/d.xml", "row", "id long").collect()) == [1, 2]
    (tmp_path / "e.log").write_text("pid=7 name=x\nnoise\n")
    assert [tuple(r) for r in readers.text_records(spark, f"{tmp_path}/e.log", r"pid=(\d+) name=(\w+)", ["pid", "name"]).collect()] == [("7", "x")]
    assert readers.binary_records(spark, f"{tmp_path}/e.log").first().length == 19


def test_stream_equals_batch(spark, sf, tmp_path):
    events = readers.table(spark, sf, "events")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    run = windows.windowed_counts(stream, "ts", "event_type").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    want = windows.windowed_counts(events, "ts", "event_type")
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, want.collect()))
    once = windows.first_seen(stream, "user_id", "ts", "60 days").writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    once.awaitTermination(120)
    assert spark.table("once").count() == events.select(F.countDistinct("user_id")).first()[0]
