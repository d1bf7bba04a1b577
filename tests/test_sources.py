"""Files, checkpoints and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tallgrass.sources import files, schemas
from tallgrass.streaming import incremental


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": 1, "response": "é\\n2"}\n\n{"id": 2}\n', encoding="utf-8")
    df = files.read_jsonl(spark, str(p), schemas.RESPONSES)
    assert sorted((r.id, r.response) for r in df.collect()) == [(1, "é\n2"), (2, None)]
    files.write_jsonl(df, str(tmp_path / "out"), order=["id"])
    text = next((tmp_path / "out").glob("part-*")).read_text(encoding="utf-8")
    assert "é" in text
    with pytest.raises(Exception):
        files.write_jsonl(df, str(tmp_path / "out"))
    bad = tmp_path / "bad.jsonl"
    bad.write_text("{oops\n")
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(bad), schemas.RESPONSES, strict=True).collect()


def test_answer_union(spark, tmp_path):
    p = tmp_path / "i.jsonl"
    p.write_text("\n".join(json.dumps(x) for x in ({"id": 1, "question": "q", "answer": "[0, 14]"}, {"id": 2, "question": "q", "answer": ["1", "2"], "options": ["a"]}, {"id": 3, "question": "q"})))
    got = {r.id: (r.answer, r.options) for r in files.read_items(spark, str(p)).collect()}
    assert got == {1: (["[0, 14]"], None), 2: (["1", "2"], ["a"]), 3: (None, None)}


def test_long_csv(spark, tmp_path):
    rows = [(1, 'a "quoted", line\nand more'), (2, "plain"), (3, "x" * 150_000)]
    df = spark.createDataFrame(rows, schemas.RESPONSES)
    assert files.write_long_csv(df, str(tmp_path / "c"), order=["id"]) == 3
    back = files.read_long_csv(spark, str(tmp_path / "c"), schemas.RESPONSES)
    assert sorted(map(tuple, back.collect())) == rows
    n = files.rewrite_csv(spark, str(tmp_path / "c"), str(tmp_path / "d"), schemas.RESPONSES, lambda d: d.withColumn("response", F.upper("response")))
    assert n == 3


def test_checkpoint_and_cache(spark, tmp_path):
    items = spark.createDataFrame([(1, "ab"), (2, "abc")], "id bigint, question string")
    path = str(tmp_path / "answers")
    assert files.remaining(items, path).count() == 2
    incremental.generate(items.where("id = 1"), incremental.stub_generator, "id bigint, response string", path)
    incremental.generate(items, incremental.stub_generator, "id bigint, response string", path)
    got = spark.read.parquet(path)
    assert sorted(r.id for r in got.collect()) == [1, 2] and files.remaining(items, path).count() == 0
    calls = []
    build = lambda: calls.append(1) or items
    files.cached(spark, str(tmp_path / "t"), "v1", build)
    files.cached(spark, str(tmp_path / "t"), "v1", build)
    files.cached(spark, str(tmp_path / "t"), "v2", build)
    assert len(calls) == 2


def test_documents_and_fingerprints(spark, tmp_path):
    p = str(tmp_path / "m.json")
    files.upsert_entry(p, "watch", "a", {"n": 1})
    assert files.upsert_entry(p, "watch", "b", {"n": 2}) == {"watch": {"a": {"n": 1}, "b": {"n": 2}}}
    with pytest.raises(FileExistsError):
        files.write_document(p, {}, overwrite=False)
    assert len(files.file_sha256(p)) == 64 and files.read_document(str(tmp_path / "no")) == {}
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    assert files.fingerprint(df) == files.fingerprint(df.repartition(5)) != files.fingerprint(df.union(df.limit(1)))
    m = files.manifest(spark.createDataFrame([("a", 10, "s1"), (None, 20, "s1")], "topic string, trace_chars int, source_id string"))
    assert m["final_row_count"] == 2 and m["topic_counts"] == {"a": 1, "unknown": 1} and m["distinct_ids"] == 1
    files.fan_out(df.withColumn("b", F.col("id") % 3), str(tmp_path / "f"), "b")
    assert len([x for x in (tmp_path / "f").iterdir() if x.is_dir()]) == 3
    assert files.scan_cap(df, "id", 7).count() == 7 and files.scan_cap(df, "id", None).count() == 100
    assert files.read_configs(lambda c: df.limit(2), ["p", "q"]).groupBy("hf_config").count().count() == 2


def test_nested_columns(spark):
    df = spark.createDataFrame([(["a", "bb", "c" * 20], [False, True, True])], "g array<string>, ok array<boolean>")
    assert df.select(files.verified_generation(F.col("g"), F.col("ok")).alias("x")).first().x == "bb"
    talk = spark.createDataFrame([([("human", "hi", None), ("assistant", "yo", None)],)], schemas.CONVERSATIONS)
    assert talk.select(files.first_turn(F.col("conversations"), "assistant").alias("x")).first().x == "yo"
    q = spark.createDataFrame([("Q: What? Answer Choices: (A) x",), ("问题：什么 选项：(A) x",), (" other ",)], "q string")
    assert [r.x for r in q.select(files.choice_question(F.col("q")).alias("x")).collect()] == ["What?", "什么", "other"]


def test_stream_equals_batch(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(i % 7, f"r{k}", k * 10 + i) for i in range(10)], "id bigint, text string, scan_idx bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    for _ in range(2):  # the second run finds nothing new
        s = incremental.stream_files(spark, str(tmp_path / "in"), schema, per_batch=1)
        incremental.curate(s, [("five", F.col("id") == 5)], str(tmp_path / "out"), str(tmp_path / "progress"), ["id"], "scan_idx").awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.id for r in got.collect()) == [0, 1, 2, 3, 4, 6]
