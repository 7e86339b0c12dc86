"""Readers of other formats: retrieval test collections, and the tables of an SQLite index file."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.codecs import decode_pairs, floats_from_blob, unpack_nibbles
from ..functions.text import metadata_json, string_metadata


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """numeric_id, text of a two-column TSV; further tabs belong to the text."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).select(parts[0].alias("numeric_id"), F.coalesce(F.get(parts, 1), F.lit("")).alias("text"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return read_corpus(spark, path).toDF("query_id", "query")


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    """query_id, uuid, grade of a JSON object of objects; a grade may be a number or numeric text."""
    text = spark.read.option("wholetext", True).text(path)
    by_query = text.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("query_id", "docs"))
    return by_query.select("query_id", F.explode("docs").alias("uuid", "grade")).withColumn("grade", F.col("grade").cast("double").cast("int"))


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("numeric_id", "uuid"))


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SQLiteSource(DataSource):
    """format("sqlite_table") with path, table and parts: a table read in ranges of its rowid, a task for each."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            kinds = {"INTEGER": "bigint", "REAL": "double", "TEXT": "string", "BLOB": "binary"}
            return ", ".join(f"`{r[1]}` {kinds.get(r[2].upper(), 'string')}" for r in c.execute(f"PRAGMA table_info({_name(self.options['table'])})"))

    def reader(self, schema) -> SQLiteReader:
        return SQLiteReader(self.options, schema)


def _name(table: str) -> str:
    return '"' + table.replace('"', '""') + '"'


class SQLiteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("parts", 8))
        self.columns = [f.name for f in schema.fields]

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
        if low is None:
            return [_Range(0, -1)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, part: _Range) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            columns = ", ".join(map(_name, self.columns))
            yield from c.execute(f"SELECT {columns} FROM {_name(self.table)} WHERE rowid BETWEEN ? AND ?", (part.low, part.high))


def read_sqlite(spark: SparkSession, path: str, table: str, parts: int = 8) -> DataFrame:
    spark.dataSource.register(SQLiteSource)
    return spark.read.format("sqlite_table").option("path", path).option("table", table).option("parts", parts).load()


def import_documents(raw: DataFrame) -> DataFrame:
    """Documents of an SQLite index: epoch seconds become timestamps, JSON becomes a map of its string members; an absent title is null."""
    title = F.col("title") if "title" in raw.columns else F.lit(None).cast("string")
    return raw.select("uuid", F.timestamp_seconds("date").alias("date"), string_metadata(F.col("metadata").cast("string")).alias("metadata"), "hash", "body", title.alias("title"))


def import_buckets(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(centroids, postings) of bucket rows (id, generation_id, center, indices, residuals)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                pairs, levels = decode_pairs(r["indices"]), unpack_nibbles(r["residuals"])
                if len(pairs):
                    levels = levels.reshape(len(pairs), -1)
                    yield pa.RecordBatch.from_arrays([pa.array([r["generation_id"]] * len(pairs)), pa.array([r["id"]] * len(pairs), pa.int32()), pa.array(pairs[:, 0].astype("int64")), pa.array(pairs[:, 1].astype("int32")), pa.array(list(levels.astype("int32")), pa.list_(pa.int32()))], ["gen", "bucket", "chunk_id", "token_offset", "levels"])

    @F.udf("array<double>")
    def center(blob: bytes):
        return [float(x) for x in floats_from_blob(blob)]

    postings = raw.select("id", "generation_id", "indices", "residuals").mapInArrow(run, "gen long, bucket int, chunk_id long, token_offset int, levels array<int>")
    counts = postings.groupBy("gen", "bucket").agg(F.count("*").alias("n"))
    centers = raw.select(F.col("generation_id").alias("gen"), F.col("id").cast("int").alias("bucket"), center("center").alias("center"))
    return centers.join(counts, ["gen", "bucket"], "left").select("gen", "bucket", "center", F.coalesce("n", F.lit(0)).alias("n")), postings


def export_sqlite(path: str, documents: DataFrame, chunks: DataFrame) -> None:
    """Documents and chunks as an SQLite file with a full-text index over title and body.

    The file is written by the driver, row by row as they stream in: an export
    for embedded readers, of a store that fits one machine's disk.
    """
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE document (uuid TEXT PRIMARY KEY, date REAL, metadata TEXT, hash TEXT, body TEXT, title TEXT)")
        c.execute("CREATE TABLE chunk (id INTEGER PRIMARY KEY, hash TEXT UNIQUE, model TEXT, token_count INTEGER)")
        c.execute("CREATE VIRTUAL TABLE document_fts USING fts5(title, body, content='document', content_rowid='rowid')")
        out = documents.select("uuid", (F.unix_micros("date") / 1e6).alias("date"), metadata_json("metadata").alias("metadata"), "hash", "body", "title")
        c.executemany("INSERT INTO document VALUES (?, ?, ?, ?, ?, ?)", (tuple(r) for r in out.toLocalIterator()))
        c.executemany("INSERT INTO chunk VALUES (?, ?, ?, ?)", (tuple(r) for r in chunks.select("id", "hash", "model", "token_count").toLocalIterator()))
        c.execute("INSERT INTO document_fts(document_fts) VALUES ('rebuild')")
        c.execute("PRAGMA user_version = 1")


def log_failures(rows: DataFrame, path: str) -> None:
    """Append rows to a folder of JSON lines, columns in alphabetical order."""
    rows.select(*sorted(rows.columns)).write.mode("append").json(path)
