import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sievewright.functions.register import register
from sievewright.sources import lines as L
from sievewright.streaming import events as E


def test_read_lines(spark, tmp_path):
    a, b = tmp_path / "a.txt", tmp_path / "b.txt"
    a.write_text("one\n\nthree\r\n", encoding="utf-8")
    b.write_text("four\n" + "x" * 50 + "\n", encoding="utf-8")
    got = [(r["source_ordinal"], r["line"], r["oversized"]) for r in L.read_lines(spark, [str(a), str(b)], 40).orderBy("source_ordinal").collect()]
    assert got == [(1, "one", False), (2, "", False), (3, "three", False), (4, "four", False), (5, None, True)]


def test_adapter(spark):
    rows = spark.createDataFrame([(1, "metin", "u", 0.5, "x"), (2, " ", "u", 1.0, "y"), (3, "iki", None, float("nan"), None)], "id long, body string, url string, score double, other string")
    adapter = L.Adapter(text="body", source_id="s", url="url", signals=("score",), declared_language="tr", skip=("id",))
    got = {r["source_ordinal"]: r for r in adapter.documents(rows, F.col("id")).collect()}
    assert sorted(got) == [1, 3]
    assert got[1]["doc_id"] == hashlib.sha256(b"metin").hexdigest() and got[1]["signals"] == {"score": 0.5} and json.loads(got[1]["extra"]) == {"other": "x"}
    assert got[3]["signals"] == {} and got[3]["language"]["declared"] == "tr"
    with pytest.raises(ValueError, match="missing"):
        L.Adapter(text="nope", source_id="s").plan(rows.columns)


def test_json_lines(spark):
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, " "), (3, '{"a": 2}')], "source_ordinal long, line string")
    assert [(r[0], r[1]) for r in L.read_json_lines(rows, "a int").orderBy("source_ordinal").collect()] == [(1, 1), (3, 2)]
    bad = spark.createDataFrame([(1, '{"a": ')], "source_ordinal long, line string")
    with pytest.raises(Exception, match="(?i)malformed"):
        L.read_json_lines(bad, "a int").collect()


def test_tsv(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_text('a\tb\n1\tx\n2\t\n3\t"with ""quotes"", a\ttab\nand a line"\n', encoding="utf-8")
    assert [tuple(r) for r in L.read_tsv(spark, str(p), "a int, b string").collect()] == [(1, "x"), (2, None), (3, 'with "quotes", a\ttab\nand a line')]
    p.write_text("a\tb\n1\tx\ty\n", encoding="utf-8")
    with pytest.raises(Exception, match="(?i)malformed"):
        L.read_tsv(spark, str(p), "a int, b string").collect()


def test_shards_and_manifest(spark, tmp_path):
    d = spark.range(1, 11).select(F.lit("s").alias("source_id"), F.col("id").alias("source_ordinal"), F.concat(F.lit("t"), "id").alias("text"))
    L.write_shards(d, str(tmp_path / "shards"), 4)
    parts = sorted((tmp_path / "shards").glob("*.parquet"))
    entries = []
    for p in parts:
        r = spark.read.parquet(str(p)).agg(F.count("*"), F.min("source_ordinal"), F.max("source_ordinal")).first()
        assert r[0] <= 4
        entries.append({"path": str(p), "bytes": p.stat().st_size, "sha256": hashlib.sha256(p.read_bytes()).hexdigest(), "rows": r[0], "first": r[1], "last": r[2]})
    assert all(r["problems"] == "" for r in L.verify_manifest(spark, entries).collect())
    entries[0]["rows"] += 1
    entries[-1]["sha256"] = "0" * 64
    bad = {r["path"]: r["problems"] for r in L.verify_manifest(spark, entries).collect()}
    assert "rows" in bad[entries[0]["path"]] and "hash" in bad[entries[-1]["path"]]
    got = L.read_shards(spark, [str(p) for p in parts], ["text"], "source_id string, source_ordinal long, text string")
    assert got.columns == ["text"] and got.count() == 10


def test_writers(spark, tmp_path):
    d = spark.createDataFrame([(2, "b", None), (1, "a", "u")], "source_ordinal long, text string, url string")
    L.write_json_lines(d, ["source_ordinal"], str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == '{"source_ordinal":1,"text":"a","url":"u"}\n{"source_ordinal":2,"text":"b","url":null}\n'
    assert L.write_manifest(d.groupBy("text").count(), str(tmp_path / "m.json")) == '[{"count":1,"text":"a"},{"count":1,"text":"b"}]\n'
    L.write_partitioned(d, str(tmp_path / "facts"), "text")
    assert spark.read.parquet(str(tmp_path / "facts")).count() == 2
    r = L.ingest_report(spark, [str(tmp_path / "m.json")]).first()
    assert r["line_feeds"] == 1 and r["utf8"] is True


def test_registered_functions(spark):
    register(spark)
    assert spark.sql("select normalize_text('ﬁ X') x").first()["x"] == "fi x"
    assert spark.sql("select * from pack_text('aa bb cc', 5)").count() == 2


def test_stream_windows_equal_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3} 0{i % 6}:10:00", "ab"[i % 2], float(i)) for i in range(40)], "event_id long, t string, event_type string, value double").select("event_id", F.to_timestamp("t").alias("ts"), "event_type", "value")
    rows.write.parquet(str(tmp_path / "in"))
    E.run_available(E.windowed(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "win"), str(tmp_path / "ck"), "complete")
    last = max((tmp_path / "win").glob("batch_id=*"), key=lambda x: int(x.name.split("=")[1]))
    assert {tuple(r) for r in spark.read.parquet(str(last)).collect()} == {tuple(r) for r in E.windowed(rows).collect()}


def test_stream_first_seen(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A  long enough text for one fingerprint"), (2, "a long enough TEXT for one fingerprint"), (3, "another long enough text for fingerprints")], "doc_id long, text string").withColumn("ingested_at", F.lit("2024-01-01").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    E.run_available(E.stream_first_seen(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "seen"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "seen")).count() == 2


def test_near_duplicate_state(spark, tmp_path):
    write = E.near_duplicate_state(spark, str(tmp_path / "kept"))
    first = spark.createDataFrame([(1, 0), (2, 1), (3, 15 << 20), (4, None), (5, 0)], "doc_id long, signature long")
    second = spark.createDataFrame([(6, 3), (7, (15 << 20) | 1), (8, 0xFFFF), (9, 0xFFFF ^ 1), (10, 255 << 40)], "doc_id long, signature long")
    for _ in range(2):  # a repeated batch gives the same
        write(first, 0)
        write(second, 1)
        got = spark.read.parquet(str(tmp_path / "kept")).select("batch_id", "class_id").collect()
        assert sorted((r["batch_id"], r["class_id"]) for r in got) == [(0, 1), (0, 3), (1, 8), (1, 10)]


def test_sweep_fills_what_is_missing(spark, tmp_path):
    write = E.missing_status_sweep(spark, str(tmp_path / "done"), lambda d: d.select("doc_id", F.lit("ok").alias("status")))
    write(spark.range(3).withColumnRenamed("id", "doc_id"), 0)
    write(spark.range(5).withColumnRenamed("id", "doc_id"), 1)
    write(spark.range(5).withColumnRenamed("id", "doc_id"), 1)
    assert sorted((r["batch_id"], r["doc_id"]) for r in spark.read.parquet(str(tmp_path / "done")).collect()) == [(0, 0), (0, 1), (0, 2), (1, 3), (1, 4)]
