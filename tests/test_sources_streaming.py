import json
import os

import pandas as pd
from pyspark.sql import functions as F

from corpusflow.sources import files, store, transcripts
from corpusflow.streaming import ingest, suppress

BODY = "이 문서는 검색을 위한 본문이다. 문장은 마침표로 끝난다. " * 12


def folder(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text(BODY, encoding="utf-8")
    (root / "b.md").write_bytes(("# 제목\n\n" + BODY).encode("cp949"))
    (root / "sub" / "c.txt").write_bytes(("﻿" + BODY).encode("utf-8"))
    (root / "bad.txt").write_bytes(b"\xff\xfe\xfa\x80\x81")
    (root / "skip.bin").write_bytes(b"x")
    return str(root)


def test_read_and_decode(spark, tmp_path):
    docs, rejects = files.load_folder(spark, folder(tmp_path))
    got = {r["file_name"]: r["encoding"] for r in docs.collect()}
    assert got == {"a.txt": "utf-8", "b.md": "cp949", "c.txt": "utf-8"}
    assert [r["path"].rsplit("/", 1)[-1] for r in rejects.collect()] == ["bad.txt"]


def test_listing(spark, tmp_path):
    listed = files.read_files(spark, folder(tmp_path))
    info = {r["file_name"]: r for r in files.file_info(listed).collect()}
    assert info["a.txt"]["size"] == len(BODY.encode()) and info["b.md"]["extension"] == "md"
    wanted = spark.createDataFrame([("a.txt",), ("none.txt",)], "file_name string")
    assert [r["file_name"] for r in files.select_files(listed, wanted).select("file_name").collect()] == ["a.txt"]


def test_admission(spark):
    df = spark.createDataFrame([("a.pdf", 10), ("a.exe", 10), ("a.txt", 104857601), ("", 1)], "n string, s bigint")
    got = [r["x"] for r in df.select(files.admission(F.col("n"), F.col("s")).alias("x")).collect()]
    assert got[0] is None and ".exe" in got[1] and "100MB" in got[2] and got[3] is not None


def test_golden(spark, tmp_path):
    path = tmp_path / "golden.json"
    path.write_text(json.dumps({"description": "d", "cases": [{"question": "q1", "expected_sources": ["a", "b"]}, {"question": "q2", "expected_sources": ["c"]}]}, indent=1))
    rows = files.golden_cases(spark, str(path)).orderBy("query_id").collect()
    assert [(r["query_id"], r["text"], r["expected"]) for r in rows] == [(0, "q1", ["a", "b"]), (1, "q2", ["c"])]


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    make = lambda rows: spark.createDataFrame(rows, "file_id string, version int, chunk_id string")
    assert store.count_chunks(spark, path) == 0 and store.versions(spark, path) is None
    first = make([("a", 1, "a_0"), ("a", 1, "a_1"), ("b", 1, "b_0")])
    store.write_chunks(first, path, "w1")
    store.write_chunks(first, path, "w1")
    assert store.count_chunks(spark, path) == 3
    store.write_chunks(first, path, "w2")
    assert store.count_chunks(spark, path) == 3
    store.write_chunks(make([("a", 2, "a_0")]), path, "w3")
    assert sorted((r["file_id"], r["version"]) for r in store.read_store(spark, path).collect()) == [("a", 2), ("b", 1)]
    store.clear_store(spark, path)
    assert store.count_chunks(spark, path) == 0


def test_ingest_is_incremental(spark, tmp_path):
    root = folder(tmp_path)
    out, report, state = (str(tmp_path / n) for n in ("store", "report", "state"))

    def run():
        ingest.ingest(spark, root, out, report, state).awaitTermination()
        return store.count_chunks(spark, out)

    first = run()
    assert first > 0 and run() == first
    (tmp_path / "in" / "new.txt").write_text(BODY + "새 문서이다. " * 30, encoding="utf-8")
    assert run() > first
    rows = [r.asDict() for r in spark.read.parquet(report).collect()]
    assert sum(r["files"] for r in rows) == 5 and sum(r["failed"] for r in rows) == 1
    assert all(r["files"] == r["refused"] + r["failed"] + r["too_short"] + r["ingested"] for r in rows)
    assert sum(r["new_chunks"] for r in rows) == store.count_chunks(spark, out)


def test_files_of_one_name_and_changed_files(spark, tmp_path):
    for name, word in (("a", "첫째"), ("b", "둘째")):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "x.txt").write_text(f"{word} 문서이다. " * 60, encoding="utf-8")
    (tmp_path / "in" / "short.txt").write_text("짧다.", encoding="utf-8")
    root, out, report = (str(tmp_path / n) for n in ("in", "store", "report"))

    def texts():
        return " ".join(r["text"] for r in store.read_store(spark, out).collect())

    ingest.ingest_changed(spark, root, out, report, "w1")
    assert "첫째" in texts() and "둘째" in texts()
    ingest.ingest_changed(spark, root, out, report, "w2")
    later = tmp_path / "in" / "a" / "x.txt"
    later.write_text("셋째 문서이다. " * 60, encoding="utf-8")
    os.utime(later, (2_000_000_000, 2_000_000_000))
    ingest.ingest_changed(spark, root, out, report, "w3")
    assert "첫째" not in texts() and "둘째" in texts() and "셋째" in texts()
    rows = {r["write_id"]: r.asDict() for r in spark.read.parquet(report).collect()}
    assert (rows["w1"]["files"], rows["w1"]["ingested"], rows["w1"]["too_short"]) == (3, 2, 1)
    assert (rows["w2"]["ingested"], rows["w3"]["ingested"]) == (0, 1)


def test_transcripts_and_markdown(spark, small, tmp_path):
    rows = spark.read.parquet(f"{small}/conversations.parquet")
    transcripts.write_transcripts(rows, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).filter(F.col("value").startswith("## ")).count() == rows.count()
    docs = spark.createDataFrame([("a", "# a\n본문")], "name string, content string")
    transcripts.write_markdown(docs, str(tmp_path / "m"))
    assert {r["value"] for r in spark.read.text(str(tmp_path / "m")).collect()} == {"# a", "본문"}


def loop(events, ttl):
    last, out = {}, {}
    for key, t, i in sorted(events, key=lambda e: (e[1], e[2])):
        fresh = key not in last or t - last[key] >= ttl
        if fresh:
            last[key] = t
        out[i] = fresh
    return out


def test_fresh_events_equal_the_loop(spark):
    import random

    rng = random.Random(3)
    events = [(rng.choice("aab"), rng.randrange(0, 40_000), i) for i in range(600)]
    df = spark.createDataFrame(events, "k string, s bigint, event_id bigint").withColumn("ts", F.timestamp_seconds("s"))
    for span in (300, 1000, 10_000):
        got = suppress.fresh_events(df.select("k", "event_id", "ts"), ["k"], ttl_seconds=300, span_seconds=span)
        assert {r["event_id"]: r["fresh"] for r in got.collect()} == loop(events, 300)


def test_fresh_events_of_two_keys_to_the_microsecond(spark):
    ttl = 300_000_000
    micros = [0, ttl - 1, ttl, 2 * ttl - 1, 2 * ttl, 2 * ttl, 86_400_000_000 - 1, 86_400_000_000, 86_400_000_000 + ttl - 2, 86_400_000_000 + ttl - 1]
    events = [((k, u), -3 * ttl + t, 100 * i + t % 7 * 10 + n) for i, (k, u) in enumerate([("a", 1), ("a", 2), ("b", 1)]) for n, t in enumerate(micros)]
    rows = [(k, u, t, i, f"{i}") for (k, u), t, i in events]
    df = spark.createDataFrame(rows, "k string, u bigint, t bigint, event_id bigint, props string").withColumn("ts", F.timestamp_micros("t"))
    got = suppress.fresh_events(df, ["k", "u"], ttl_seconds=300).collect()
    assert {r["event_id"]: r["fresh"] for r in got} == loop(events, ttl)
    assert all(r["props"] == str(r["event_id"]) for r in got)
    assert suppress.fresh_events(df.limit(0), ["k", "u"]).collect() == []


def test_fresh_stream(spark, tmp_path):
    source = str(tmp_path / "events")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    start = 1_700_000_000
    want = {("q", 0): True, ("q", 100): False, ("q", 299): False, ("q", 300): True, ("p", 10): True, ("q", 650): True}
    rows = [(k, start + s) for k, s in want]
    df = spark.createDataFrame(rows, "k string, s bigint").select("k", F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    query = suppress.fresh_stream(stream, ["k"]).writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["k"], int(r["ts"].timestamp()) - start): r["fresh"] for r in spark.table("fresh").collect()}
    assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")
