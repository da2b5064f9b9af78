"""Readers of manifests, matrices, chunk files, bundles and settings, and the resumable stream."""

import hashlib
import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from anvilgrid.functions import text as T
from anvilgrid.sources import readers, sinks
from anvilgrid.streaming.resume import evaluate_stream


def test_manifest_offsets(spark, tmp_path):
    part = lambda n: {"vector_file": "v.npy", "metadata_file": "m", "chunk_file": "c", "chunk_count": n, "metadata_sha256": "x", "source_sha256": "y"}
    (tmp_path / "m.json").write_text(json.dumps({"dimensions": 3, "series": {"22": part(4), "21": part(2), "23": part(1)}}))
    rows = readers.manifest(spark, str(tmp_path / "m.json")).orderBy("ord").collect()
    assert [(r["series"], r["offset"], r["chunk_count"], r["dimensions"]) for r in rows] == [("22", 0, 4, 3), ("21", 4, 2, 3), ("23", 6, 1, 3)]


def test_matrix(spark, tmp_path):
    m = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "a.npy", m)
    rows = readers.matrix(spark, str(tmp_path / "a.npy")).orderBy("embedding_row").collect()
    assert [r["file"] for r in rows] == ["a.npy"] * 4 and [list(r["embedding"]) for r in rows] == m.tolist()


def test_chunk_files(spark, tmp_path):
    chunks = [{"chunk_id": "a", "text": "x"}, {"chunk_id": "b", "text": "y", "source_chunk_index": 7}]
    (tmp_path / "l.json").write_text(json.dumps(chunks))
    (tmp_path / "o.json").write_text(json.dumps({"chunks": chunks}))
    rows = readers.chunk_files(spark, str(tmp_path)).orderBy("file", "chunk_id").collect()
    assert [(r["file"], r["chunk_id"], r["source_chunk_index"]) for r in rows] == [("l.json", "a", 0), ("l.json", "b", 7), ("o.json", "a", 0), ("o.json", "b", 7)]


def test_docx_paragraphs():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>AB</w:t><w:tab/><w:t>Some words</w:t></w:r></w:p><w:p/></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
    assert readers.docx_paragraphs(out.getvalue()) == ["AB\tSome words", ""]


def test_bundle_problems(spark, tmp_path):
    there = spark.createDataFrame([("a", 1, "s"), ("b", 2, "s"), ("c", 3, "t"), ("../e", 1, "s")], "path string, size long, sha256 string")
    listed = spark.createDataFrame([("a", 1, "s"), ("b", 1, "s"), ("c", 3, "s"), ("d", 1, "s"), ("../e", 1, "s")], "path string, size long, sha256 string")
    assert {r["path"]: r["problem"] for r in readers.verify(there, listed).collect()} == {"b": "size", "c": "sha256", "d": "missing", "../e": "not allowed"}
    (tmp_path / "f").write_bytes(b"abc")
    row = readers.files(spark, str(tmp_path)).first()
    assert (row["size"], row["sha256"]) == (3, hashlib.sha256(b"abc").hexdigest())


def test_settings(tmp_path):
    (tmp_path / "c.toml").write_text("[a]\nb = 1\n")
    config = readers.settings(str(tmp_path / "c.toml"))
    assert readers.setting(config, "a", "b") == 1
    with pytest.raises(KeyError):
        readers.setting(config, "a", "c")
    assert readers.flat_config({"a": {"b": None, "c": [1, "x"]}, "d": "t"}) == {"a.b": "null", "a.c": '[1, "x"]', "d": "t"}
    assert readers.labelled_path(" one = /p ") == ("one", "/p")
    with pytest.raises(ValueError, match="LABEL=PATH"):
        readers.labelled_path("one")


def test_stream_answers_each_question_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []

    def evaluate(batch):
        seen.append(sorted(r["question_id"] for r in batch.collect()))
        return batch.withColumn("answer", F.upper("question_id"))

    def go():
        evaluate_stream(spark, str(tmp_path / "in"), "question_id string", str(tmp_path / "out"), str(tmp_path / "state"), evaluate).awaitTermination()

    (tmp_path / "in/1.json").write_text('{"question_id":"a"}\n{"question_id":"b"}\n{"question_id":"a"}\n')
    go()
    (tmp_path / "in/2.json").write_text('{"question_id":"b"}\n{"question_id":"c"}\n')
    go()
    assert seen == [["a", "b"], ["c"]]
    assert sorted(r["answer"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["A", "B", "C"]


def test_an_epoch_that_is_tried_again_replaces_itself(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"question_id":"a"}\n{"question_id":"b"}\n')

    def go(evaluate):
        evaluate_stream(spark, str(tmp_path / "in"), "question_id string", str(tmp_path / "out"), str(tmp_path / "state"), evaluate).awaitTermination()

    def crash(batch):
        import shutil

        batch.withColumn("answer", F.lit("first")).withColumns({"stream": F.lit(name), "epoch": F.lit(0)}).write.partitionBy("stream", "epoch").parquet(str(tmp_path / "out"))
        raise RuntimeError("lost")

    name = hashlib.sha256(str(tmp_path / "state").encode()).hexdigest()[:16]
    with pytest.raises(Exception, match="lost"):
        go(crash)
    go(lambda batch: batch.withColumn("answer", F.lit("second")))
    assert sorted((r["question_id"], r["answer"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", "second"), ("b", "second")]


def test_vocabulary_sections(spark):
    lines = ["References", "x: not yet", "AB\tnor this", "References", "early: no section", "3 Terms and definitions", " cell : an area.. ", "no entry", "AB\tnot here", "Abbreviations", "AB\tSome words.", "C\ttoo short", "late: no tab", "cell: no term here", "AB\tOther words", "Terms and definitions", "cell: again."]
    rows = readers.vocabulary_paragraphs(spark.createDataFrame(list(enumerate(lines)), "pos long, text string")).collect()
    assert sorted((r["kind"], r["key"], r["value"]) for r in rows) == [("abbreviation", "AB", "Other words"), ("term", "cell", "again")]


def test_vocabulary_json(spark, tmp_path):
    source = lambda s, k: {"series": s, "source_document_key": k}
    (tmp_path / "d.json").write_text(json.dumps({"terms": [{"term": "b", "definition": "x"}, {"term": "a", "definition": "y."}, {"term": "b", "definition": "z"}]}))
    acronyms = {"AB": [{"expansion": " All Bits ", "sources": [source("21", "p/21.900/"), source("22", "q\\\\22.1")]}, {"expansion": "all-bits", "sources": [source("21", "z")]}], "CD": [{"expansion": "One", "sources": [source("1", "a")]}, {"expansion": "Two", "sources": [source("2", "b")]}], "EF": [], "GH": [{"expansion": " ", "sources": [source("1", "a")]}]}
    (tmp_path / "a.json").write_text(json.dumps({"acronyms": acronyms}))
    rows = readers.vocabulary_json(spark, str(tmp_path / "d.json"), str(tmp_path / "a.json")).collect()
    assert sorted((r["kind"], r["key"], r["value"]) for r in rows) == [("abbreviation", "AB", "All Bits"), ("term", "a", "y."), ("term", "b", "z")]
    (tmp_path / "bad.json").write_text('{"terms": [{"term": "b"}]}')
    with pytest.raises(Exception, match="an invalid term"):
        readers.vocabulary_json(spark, str(tmp_path / "bad.json"), str(tmp_path / "a.json")).collect()


def test_anchor_and_router_files(spark, tmp_path):
    np.savez(tmp_path / "a.npz", series_keys=["21", "22"], document_keys=["x"], series_vectors=[[3.0, 4.0], [0.0, 2.0]], document_vectors=[[1.0, 0.0]])
    rows = readers.anchor_vectors(spark, str(tmp_path / "a.npz"), 2).collect()
    assert sorted((r["level"], r["key"], tuple(r["anchor"])) for r in rows) == [("document", "x", (1.0, 0.0)), ("series", "21", (0.6, 0.8)), ("series", "22", (0.0, 1.0))]
    with pytest.raises(Exception, match="another shape"):
        readers.anchor_vectors(spark, str(tmp_path / "a.npz"), 3).collect()
    (tmp_path / "r.json").write_text(json.dumps({"22 series two": {"description": "b", "embeddings": [1, 2]}, "21 series": {"description": "a", "embeddings": [3, 4]}}))
    assert [(r["ord"], r["series"], r["description"], list(r["anchor"])) for r in readers.router_descriptions(spark, str(tmp_path / "r.json")).orderBy("ord").collect()] == [(0, "22", "b", [1.0, 2.0]), (1, "21", "a", [3.0, 4.0])]
    np.savez(tmp_path / "w.npz", alpha=0.5)
    assert readers.router_checkpoint(str(tmp_path / "w.npz"))["alpha"] == 0.5


def test_question_files(spark, tmp_path):
    body = {"q 2": {"question": "What?", "Option 2": "b", "option 1": "a", "option 0": "no", "option3": "no", "answer": "option 2: b", "category": "C"}, "q 10": {"question": " ", "option 1": "a"}, "skip": 7}
    (tmp_path / "q.json").write_text(json.dumps(body))
    q = readers.question_set(spark, str(tmp_path / "q.json"))
    rows = {r["question_id"]: r for r in q.collect()}
    assert set(rows) == {"q 2", "q 10"} and [(o["n"], o["text"]) for o in rows["q 2"]["options"]] == [(1, "a"), (2, "b")]
    assert {r["question_id"]: r["why"] for r in readers.invalid_questions(q).collect()} == {"q 10": "no question"}
    assert [r[0] for r in q.orderBy(T.natural_order(F.col("question_id"))).select("question_id").collect()] == ["q 2", "q 10"]
    assert (T.output_name("r"), T.output_name("r", 5), T.output_name("r", 5, True), T.output_name("r", None, True)) == ("r", "r-head5", "r-tail5", "r-reverse")


def test_bundles(spark, tmp_path):
    (tmp_path / "src/chunks").mkdir(parents=True)
    (tmp_path / "src/chunks/a.json").write_text("[]")
    (tmp_path / "src/b.txt").write_text("b")
    paths = [("chunks/a.json", True), ("chunks/a.npy", False), ("/chunks/a.json", False), ("chunks/../a.json", False), ("chunks/.cache/a.json", False), ("embeddings/x/y.npz", True), ("b.txt", False)]
    df = spark.createDataFrame(paths, "path string, ok boolean")
    assert all(r[0] == r[1] for r in df.select("ok", readers.is_runtime_asset(F.col("path")).alias("got")).collect())
    staged = sinks.stage_bundle(spark, str(tmp_path / "src"), str(tmp_path / "out"), df.where("path in ('chunks/a.json', 'b.txt')"))
    content = sinks.bundle_manifest(staged, {"series": 1})
    assert [f["path"] for f in content["files"]] == ["b.txt", "chunks/a.json"]
    sinks.write_document(spark, str(tmp_path / "m.json"), content)
    listed = readers.bundle(spark, str(tmp_path / "m.json"))
    assert readers.verify(staged, listed).count() == 0 and listed.count() == 2
    with pytest.raises(ValueError, match="there already"):
        sinks.stage_bundle(spark, str(tmp_path / "src"), str(tmp_path / "out"), df)
    for wrong, why in (({**content, "format_version": 2}, "unknown format"), ({**content, "files": content["files"] * 2}, "twice"), ({**content, "files": []}, "without files")):
        (tmp_path / "w.json").write_text(json.dumps(wrong))
        with pytest.raises(Exception, match=why):
            readers.bundle(spark, str(tmp_path / "w.json")).collect()
    (tmp_path / "src/link").symlink_to(tmp_path / "src/b.txt")
    assert readers.links(str(tmp_path / "src")) == [str(tmp_path / "src/link")]
    assert readers.repository_path("root/a/b", str(tmp_path / "root"), "root") == tmp_path / "root/a/b"


def test_manifests_and_reports(spark, tmp_path):
    prints = spark.createDataFrame([("terms", "t.json", "ff")], "role string, path string, sha256 string")
    path = sinks.write_manifest(spark, str(tmp_path / "run.jsonl"), {"k": 8, "é": None}, prints)
    assert path.endswith("run.manifest.json") and json.loads((tmp_path / "run.manifest.json").read_text()) == {"k": 8, "é": None, "terms_path": "t.json", "terms_sha256": "ff"}
    sinks.write_table(prints, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).collect() == prints.collect()
    assert sinks.comparison(prints, runs=2)["overlaps"] == [{"role": "terms", "path": "t.json", "sha256": "ff"}]
    assert sinks.debug_path("a/b.jsonl") == "a/b_debug.json"
