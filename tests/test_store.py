from __future__ import annotations

import json
import sqlite3

import numpy as np
import pytest

from tokenloom.functions.codecs import encode_pairs, floats_to_blob, pack_nibbles
from tokenloom.operators.embed import HashEmbedder
from tokenloom.operators.filters import MetadataEquals
from tokenloom.operators.lsm import IndexConfig
from tokenloom.sources.files import export_sqlite, import_buckets, import_documents, log_failures, read_corpus, read_id_map, read_judgements, read_sqlite
from tokenloom.store import AlreadyShutDown, SearchConfig, SearchTimeout, Store
from tokenloom.streaming.ingest import ingest, matching

COLUMNS = "uuid string, title string, body string, metadata map<string,string>"


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), HashEmbedder(), index=IndexConfig(base=8), search=SearchConfig(deadline=300))


def test_life_of_a_store(spark, store):
    rows = [("a", None, "apples and oranges", {"k": "1"}), ("b", "Fruit", "grapes and pears", {}), ("c", None, "the quick brown fox", {}), ("d", None, "apples and oranges", {"k": "2"})]
    store.add(spark.createDataFrame(rows, COLUMNS))
    events = []
    store.on_compaction = events.append
    assert store.index()["tokens"] == 14 and len(events) == 1  # a and d share a chunk
    assert store.index() is None
    hits = store.search("apples oranges").hits
    assert [h["uuid"] for h in hits[:2]] == ["a", "d"] and hits[0]["fts_rank"] == 1
    assert [h["uuid"] for h in store.search("apples", filter=MetadataEquals("k", "2")).hits] == ["d"]
    assert store.search("", 5).hits == [] and store.search("apples", 0).hits == []
    with pytest.raises(SearchTimeout):
        store.search("apples", deadline=0.0)
    store.add(spark.createDataFrame([("a", None, "lemon trees grow", {})], COLUMNS))  # replaces a
    assert store.document_count() == 4
    store.remove(["c"])
    result = store.vacuum()
    assert result["chunks_removed"] == 1 and result["remaining"] == 0 and result["bytes_freed"] > 0
    assert store.find_orphans().count() == 0
    assert store.search("lemon").hits[0]["uuid"] == "a"
    assert store.recover() == {"conflicts": 0}
    store.clear_index()
    assert store.find_orphans().count() == 3
    store.add(spark.createDataFrame([("b", "Fruit", "grapes and pears", {})], COLUMNS))  # repaired by adding again
    assert store.find_orphans().count() == 2
    scores = store.score("apples", ["apples pie", "", "fox"])
    assert abs(scores[0] - 1) < 1e-5 and scores[1] == 0
    store.shutdown()
    with pytest.raises(AlreadyShutDown):
        store.search("x")


def test_stream_equals_batch(spark, store, tmp_path):
    src = str(tmp_path / "in")
    rows = [(str(i), None, f"document {i % 5} about apples", {"k": str(i % 2)}) for i in range(20)]
    for part in range(2):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], COLUMNS).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(src)
    query = ingest(matching(stream, MetadataEquals("k", "0")), store, checkpoint=str(tmp_path / "cp"))
    query.awaitTermination(240)
    assert query.exception() is None
    assert sorted(r.uuid for r in store.documents().collect()) == sorted(str(i) for i in range(0, 20, 2))
    assert store.tables.read("chunks").count() == 5


def test_retrieval_files(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("1\tfirst text\n2\twith\ttabs\n")
    (tmp_path / "q.json").write_text(json.dumps({"q1": {"d1": 2, "d2": "1"}, "q2": {"d3": 0.0}}))
    (tmp_path / "m.json").write_text(json.dumps({"1": "d1"}))
    assert [tuple(r) for r in read_corpus(spark, str(tmp_path / "c.tsv")).collect()] == [("1", "first text"), ("2", "with\ttabs")]
    assert sorted(map(tuple, read_judgements(spark, str(tmp_path / "q.json")).collect())) == [("q1", "d1", 2), ("q1", "d2", 1), ("q2", "d3", 0)]
    assert read_id_map(spark, str(tmp_path / "m.json")).first().uuid == "d1"


def test_sqlite_import(spark, tmp_path):
    path = str(tmp_path / "x.db")
    c = sqlite3.connect(path)
    c.execute("CREATE TABLE document (uuid TEXT PRIMARY KEY, date REAL, metadata BLOB, hash TEXT, body TEXT, title TEXT)")
    c.executemany("INSERT INTO document VALUES (?, ?, ?, ?, ?, ?)", [("a", 86400.5, b'{"k":"v","n":5}', "h", "body", None), ("b", 0.0, b"", "h2", "text", "T")])
    c.execute("CREATE TABLE bucket (id INTEGER PRIMARY KEY, generation_id INTEGER, center BLOB, indices BLOB, residuals BLOB)")
    levels = np.arange(8) % 16
    c.execute("INSERT INTO bucket VALUES (1, 3, ?, ?, ?)", (floats_to_blob(np.ones(4)), encode_pairs(np.array([[1, 0], [2, 5]])), pack_nibbles(levels)))
    c.commit(), c.close()
    docs = {r.uuid: r for r in import_documents(read_sqlite(spark, path, "document", 2)).collect()}
    assert docs["a"].metadata == {"k": "v"} and docs["b"].metadata == {} and docs["a"].title is None
    centroids, postings = import_buckets(read_sqlite(spark, path, "bucket"))
    assert [(r.gen, r.bucket, r.n, r.center) for r in centroids.collect()] == [(3, 1, 2, [1.0] * 4)]
    assert [(r.chunk_id, r.token_offset, r.levels) for r in postings.orderBy("chunk_id").collect()] == [(1, 0, [0, 1, 2, 3]), (2, 5, [4, 5, 6, 7])]


def test_sqlite_export(spark, tmp_path):
    import datetime as dt

    docs = spark.createDataFrame([("a", dt.datetime(1970, 1, 2), {"k": "v"}, "h", "red fox", None), ("b", None, {}, "h2", "blue", "Fox")], "uuid string, date timestamp, metadata map<string,string>, hash string, body string, title string")
    chunks = spark.createDataFrame([(1, "h", "m", 2)], "id long, hash string, model string, token_count int")
    export_sqlite(str(tmp_path / "o.db"), docs, chunks)
    back = {r.uuid: r for r in import_documents(read_sqlite(spark, str(tmp_path / "o.db"), "document")).collect()}
    assert back["a"].metadata == {"k": "v"} and back["a"].date == dt.datetime(1970, 1, 2) and back["b"].date is None
    with sqlite3.connect(str(tmp_path / "o.db")) as c:
        assert [r[0] for r in c.execute("SELECT uuid FROM document_fts JOIN document ON document.rowid = document_fts.rowid WHERE document_fts MATCH 'fox' ORDER BY uuid")] == ["a", "b"]


def test_failure_log(spark, tmp_path):
    df = spark.createDataFrame([("x", 1)], "what string, at int")
    log_failures(df, str(tmp_path / "log"))
    log_failures(df, str(tmp_path / "log"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert lines == [{"at": 1, "what": "x"}] * 2
