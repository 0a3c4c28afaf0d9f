import io
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.sources import files
from gleanery.streaming import stateless


def test_text_sources(spark, tmp_path):
    (tmp_path / "neg").write_bytes(b"bad caf\xe9 one\nbad two\n")
    (tmp_path / "pos").write_text("good one\n")
    got = sorted(map(tuple, files.polarity(spark, str(tmp_path / "neg"), str(tmp_path / "pos")).collect()))
    assert got == [("bad caf one", "negative"), ("bad two", "negative"), ("good one", "positive")]
    (tmp_path / "list").write_text("# note\n\n  a, b \n#x\nc\n")
    assert [r["line"] for r in files.commented_lines(spark, str(tmp_path / "list")).collect()] == ["a, b", "c"]
    assert [r["fields"] for r in files.commented_rows(spark, str(tmp_path / "list")).collect()] == [["a", " b"], ["c"]]
    (tmp_path / "v.json").write_text('{"a": 1,\n "b": 0}')
    assert sorted(map(tuple, files.vocabulary_json(spark, str(tmp_path / "v.json")).collect())) == [("a", 1), ("b", 0)]
    (tmp_path / "t.csv").write_text("RowKey,Question,Response,aspect,sentiment,keyword\nk,q,\"a, b\",asp,-1,kw\n")
    r = files.transfer_csv(spark, str(tmp_path / "t.csv")).first()
    assert (r["Response"], r["sentiment"], r["sentiment_name"]) == ("a, b", -1, "negative")
    assert [tuple(r) for r in files.corpus(spark, ["x", "y"]).collect()] == [(0, "x"), (1, "y")]


def test_vector_sources_and_sinks(spark, tmp_path):
    (tmp_path / "g").write_text("a 1.0 2.5\nb -1 0\n")
    assert sorted((r["word"], r["vec"]) for r in files.vectors_text(spark, str(tmp_path / "g")).collect()) == [("a", [1.0, 2.5]), ("b", [-1.0, 0.0])]
    only = files.vectors_text(spark, str(tmp_path / "g"), spark.createDataFrame([("b",)], "word string"))
    assert [r["word"] for r in only.collect()] == ["b"]
    (tmp_path / "y").write_text("new york 1 2\nx 3 4\n")
    assert sorted((r["word"], r["vec"]) for r in files.vectors_last_fields(spark, str(tmp_path / "y"), 2).collect()) == [("new york", [1.0, 2.0]), ("x", [3.0, 4.0])]
    (tmp_path / "asp").write_text("food:1 2\nbroken\n")
    assert [(r["word"], r["vec"]) for r in files.aspect_vectors(spark, str(tmp_path / "asp")).collect()] == [("food", [1.0, 2.0])]
    m = np.arange(6, dtype=np.float32).reshape(3, 2)
    np.save(tmp_path / "m.npy", m)
    assert [(r["word_id"], r["vec"]) for r in files.matrix_npy(spark, str(tmp_path / "m.npy")).collect()] == [(i, m[i].tolist()) for i in range(3)]
    with open(tmp_path / "w.bin", "wb") as f:
        f.write(b"2 2\n" + b"a " + np.array([1, 2], np.float32).tobytes() + b"\n" + b"bb " + np.array([3, 4], np.float32).tobytes() + b"\n")
    assert [(r["word"], r["vec"]) for r in files.word2vec_binary(spark, str(tmp_path / "w.bin")).collect()] == [("a", [1.0, 2.0]), ("bb", [3.0, 4.0])]
    df = spark.createDataFrame([("b", [0.123456]), ("a", [1.0])], "word string, vec array<float>")
    files.save_vectors(df, str(tmp_path / "ow"), str(tmp_path / "ov"), single=True)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "ov")).collect()] == ["a 1.00000", "b 0.12346"]
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "ow")).collect()) == ["a", "b"]
    files.save_table(df, str(tmp_path / "p"))
    assert files.load_table(spark, str(tmp_path / "p")).count() == 2
    v = spark.createDataFrame([("a", 0)], "word string, word_id int")
    assert sorted(map(tuple, files.vocabulary_fields({"text": v, "aspect": v}).collect())) == [("aspect", "a", 0), ("text", "a", 0)]


def test_folders_and_archives(tmp_path):
    at = files.ensure_dir(str(tmp_path / "d"))
    (tmp_path / "d" / "f").write_text("x")
    files.ensure_dir(at)
    assert (tmp_path / "d" / "f").exists()
    files.ensure_dir(at, erase=True)
    assert not (tmp_path / "d" / "f").exists()
    for name, ok in (("good/f.txt", True), ("../evil.txt", False)):
        with tarfile.open(tmp_path / "a.tar", "w") as t:
            info = tarfile.TarInfo(name)
            info.size = 1
            t.addfile(info, io.BytesIO(b"x"))
        if ok:
            assert files.unpack(str(tmp_path / "a.tar"), str(tmp_path / "out")) == [name]
        else:
            with pytest.raises(tarfile.TarError):
                files.unpack(str(tmp_path / "a.tar"), str(tmp_path / "out"))
    assert not (tmp_path / "evil.txt").exists()


def test_streams(spark, tmp_path):
    rows = [(1, "The battery life is great.", "2024-01-01 00:00:00"), (2, None, "2024-01-01 00:01:00"), (3, "The screen is bad.", "2024-01-01 00:09:00")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = stateless.enrich(stateless.read_documents(spark, str(tmp_path / "in"), "doc_id long, text string, ts timestamp"))
    seen = []
    stateless.write_batches(stream, lambda b, i: seen.extend(b.select("doc_id", "aspect", "sentiment").collect()), str(tmp_path / "ck")).awaitTermination()
    want = {r["doc_id"]: r for r in stateless.enrich(df).select("doc_id", "aspect", "sentiment").collect()}
    assert {r["doc_id"]: r for r in seen} == want and want[1]["aspect"] == ["battery life"]
    counts = stateless.windowed_aspects(stream, "ts")
    q = counts.writeStream.format("memory").queryName("aspects").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) n from aspects").first()["n"] == 2
