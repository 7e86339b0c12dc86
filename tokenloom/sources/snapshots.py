"""Tables of a store as Parquet snapshots behind one manifest file.

A change writes new table directories and then swaps the manifest by renaming a
file; readers see the old state or the new one, never a mixture. Directories that
no manifest names are removed by purge().
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DOCUMENTS = "uuid string, date timestamp, metadata map<string,string>, hash string, body string, title string"
CHUNKS = "id long, hash string, model string, token_count int"
TOKENS = "chunk_id long, token_offset int, vec array<float>"
GENERATIONS = "gen long, level int, n_tokens long, min_chunk long, max_chunk long, created timestamp"
CENTROIDS = "gen long, bucket int, center array<double>, n long"
POSTINGS = "gen long, bucket int, chunk_id long, token_offset int, levels array<int>"
TABLES = {"documents": DOCUMENTS, "chunks": CHUNKS, "pending": TOKENS, "generations": GENERATIONS, "centroids": CENTROIDS, "postings": POSTINGS}


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))

    def manifest(self) -> dict:
        at = self._path(f"{self.path}/manifest.json")
        if not self._fs.exists(at):
            return {"version": 0, "tables": {}}
        return json.loads("".join(r[0] for r in self.spark.read.option("wholetext", True).text(f"{self.path}/manifest.json").collect()))

    def read(self, name: str) -> DataFrame:
        """A table as of now; empty if nothing was written. Columns that older files lack are null."""
        where = self.manifest()["tables"].get(name)
        schema = T._parse_datatype_string(TABLES[name])
        if where is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{where}")

    def commit(self, **tables: DataFrame) -> int:
        """Write the given tables and make them current together. The version after it."""
        old = self.manifest()
        new = dict(old["tables"])
        for name, df in tables.items():
            schema = T._parse_datatype_string(TABLES[name])
            where = f"{name}-{uuid.uuid4().hex}"
            out = df.select([df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
            (out.write.partitionBy("gen") if name == "postings" else out.write).parquet(f"{self.path}/{where}")
            new[name] = where
        text = json.dumps({"version": old["version"] + 1, "tables": new}, sort_keys=True)
        part = self._path(f"{self.path}/.manifest-{uuid.uuid4().hex}")
        stream = self._fs.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        current = self._path(f"{self.path}/manifest.json")
        files = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        # Over the old manifest in one step: there is always one to read.
        renames = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        renames[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        files.rename(self._fs.makeQualified(part), self._fs.makeQualified(current), renames)
        return old["version"] + 1

    def clear(self) -> None:
        self.commit(**{n: self.spark.createDataFrame([], T._parse_datatype_string(s)) for n, s in TABLES.items()})

    def unreferenced(self) -> tuple[list, int]:
        named = set(self.manifest()["tables"].values())
        gone = [s.getPath() for s in self._fs.listStatus(self._path(self.path)) if s.isDirectory() and s.getPath().getName() not in named]
        return gone, sum(self._fs.getContentSummary(p).getLength() for p in gone)

    def purge(self) -> int:
        """Remove tables that are not current; the bytes that were freed."""
        gone, size = self.unreferenced()
        for p in gone:
            self._fs.delete(p, True)
        return size
