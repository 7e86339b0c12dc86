"""A document store with hybrid search: add, remove, index, search, repair, vacuum."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .functions.text import content_hash, embedding_text
from .functions.vectors import add, cluster_count, decode_levels, encode_levels, subtract
from .operators import kmeans, lsm, maintain, maxsim, ranking, textsearch
from .operators.embed import Embedder, embed
from .operators.filters import All, Filter, apply
from .sources.snapshots import SnapshotStore


class AlreadyShutDown(RuntimeError):
    pass


class SearchTimeout(TimeoutError):
    pass


@dataclass(frozen=True)
class SearchConfig:
    k: int = 32
    token_budget: int = 40_000
    threshold: float = 0.0
    rrf_k: int = 60
    budget: int = 50
    title_weight: float = 3.0
    match: str = "all"
    deadline: float = 60.0  # a Spark job takes seconds where an embedded index takes milliseconds

    def __post_init__(self) -> None:
        if self.k < 1 or self.token_budget < 1 or self.rrf_k < 0 or self.budget < 1 or self.title_weight < 0 or self.match not in ("all", "any"):
            raise ValueError("search settings out of range")


@dataclass
class SearchResult:
    hits: list
    seconds: dict[str, float] = field(default_factory=dict)


class Store:
    """One writer at a time: changes are serialised by a lock and committed as snapshots."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder, *, index: lsm.IndexConfig | None = None, search: SearchConfig | None = None, on_compaction: Callable[[dict], None] | None = None):
        self.spark, self.tables, self.embedder = spark, SnapshotStore(spark, path), embedder
        self.config, self.search_config, self.on_compaction = index or lsm.IndexConfig(), search or SearchConfig(), on_compaction
        self.lock, self.closed = threading.RLock(), False

    def _open(self) -> None:
        if self.closed:
            raise AlreadyShutDown("the store is shut down")

    # -- documents

    def add(self, docs: DataFrame) -> int:
        """docs (uuid, body; optionally title, date, metadata). Of rows that repeat a uuid the latest by date counts, then that with the greatest text. The version after it."""
        self._open()
        given = {c: F.col(c) if c in docs.columns else F.lit(None) for c in ("title", "date", "metadata")}
        full = docs.select(
            "uuid", given["date"].cast("timestamp").alias("date"), F.coalesce(given["metadata"].cast("map<string,string>"), F.create_map().cast("map<string,string>")).alias("metadata"),
            "body", given["title"].cast("string").alias("title"),
        )
        last = W.partitionBy("uuid").orderBy(F.desc_nulls_last("date"), F.desc("body"), F.desc_nulls_last("title"), F.desc(F.to_json("metadata")))
        full = full.withColumn("place_", F.row_number().over(last)).where("place_ = 1").drop("place_")
        full = full.withColumn("text", embedding_text(F.col("title"), F.col("body"))).withColumn("hash", content_hash("text"))
        with self.lock:
            chunks, pending = self.tables.read("chunks"), self.tables.read("pending")
            refs = maintain.ref_counts(self.tables.read("postings"))
            texts = full.groupBy("hash").agg(F.first("text").alias("text"))
            tokens = embed(texts, self.embedder, id="hash", text="text").persist()
            counts = texts.select("hash").join(tokens.groupBy("hash").agg(F.count("*").alias("token_count")), "hash", "left").select("hash", F.lit(self.embedder.model).alias("model"), F.coalesce("token_count", F.lit(0)).cast("int").alias("token_count"))
            all_chunks = maintain.insert_chunks(chunks, counts).persist()
            plan = maintain.dedup_plan(counts, all_chunks, refs, pending.select("chunk_id").distinct())
            wanted = plan.where(F.col("action").isin("new", "rebuild")).select("hash", "chunk_id")
            fresh = tokens.join(wanted, "hash").select("chunk_id", "token_offset", "vec")
            half = plan.where("action = 'rebuild'").select("chunk_id")
            changes = {"documents": maintain.upsert(self.tables.read("documents"), full), "chunks": all_chunks, "pending": pending.unionByName(fresh)}
            if half.head(1):
                changes["postings"] = self.tables.read("postings").join(half, "chunk_id", "left_anti")
            version = self.tables.commit(**changes)
            tokens.unpersist(), all_chunks.unpersist()
            return version

    def remove(self, uuids: list[str]) -> int:
        self._open()
        with self.lock:
            gone = self.spark.createDataFrame([(u,) for u in uuids], "uuid string")
            return self.tables.commit(documents=maintain.delete(self.tables.read("documents"), gone))

    def clear(self) -> None:
        self._open()
        with self.lock:
            self.tables.clear()

    def documents(self, filter: Filter = All()) -> DataFrame:
        self._open()
        return apply(self.tables.read("documents"), filter)

    def document_count(self) -> int:
        return self.documents().count()

    # -- index

    def index(self) -> dict | None:
        """Move pending tokens into a generation, merged with those the cascade takes in. None if nothing was pending."""
        self._open()
        with self.lock:
            began = time.time()
            pending = self.tables.read("pending")
            n_new = pending.count()
            if not n_new:
                return None
            generations, postings, centroids = (self.tables.read(x) for x in ("generations", "postings", "centroids"))
            sums = {r.level: r.n_tokens for r in lsm.level_sums(generations).collect()}
            level = lsm.cascade_level(n_new, sums, self.config)
            merged = [r.gen for r in generations.where(F.col("level") <= level).select("gen").collect()]
            old = self.vectors(postings.where(F.col("gen").isin(merged)), centroids) if merged else None
            tokens = pending if old is None else old.select("chunk_id", "token_offset", F.col("vec").cast("array<float>").alias("vec")).unionByName(pending)
            tokens = tokens.persist()
            n = tokens.count()
            sample = kmeans.training_sample(tokens, self.config.seed).withColumn("id", F.struct("chunk_id", "token_offset"))
            k = cluster_count(n, sample.count(), self.config.coefficient)
            centers = kmeans.fit(sample.select("id", "vec"), k, iterations=self.config.iterations, seed=self.config.seed)
            given = kmeans.assign(tokens.select(F.struct("chunk_id", "token_offset").alias("id"), "vec"), centers)
            placed = given.join(F.broadcast(centers), "bucket").select("bucket", "id.chunk_id", "id.token_offset", encode_levels(subtract("vec", "center")).alias("levels"))
            gen = (generations.agg(F.coalesce(F.max("gen"), F.lit(0))).first()[0]) + 1
            placed = placed.withColumn("gen", F.lit(gen)).persist()
            counts = centers.join(placed.groupBy("bucket").agg(F.count("*").alias("n")), "bucket", "left").select(F.lit(gen).alias("gen"), "bucket", "center", F.coalesce("n", F.lit(0)).alias("n"))
            span = tokens.agg(F.min("chunk_id").alias("min_chunk"), F.max("chunk_id").alias("max_chunk"))
            row = span.select(F.lit(gen).alias("gen"), F.lit(level).alias("level"), F.lit(n).alias("n_tokens"), "min_chunk", "max_chunk", F.current_timestamp().alias("created"))
            keep = ~F.col("gen").isin(merged) if merged else F.lit(True)
            self.tables.commit(
                generations=generations.where(keep).unionByName(row), centroids=centroids.where(keep).unionByName(counts), postings=postings.where(keep).unionByName(placed.select(postings.columns)),
                pending=pending.where(F.lit(False)),
            )
            tokens.unpersist(), placed.unpersist()
            event = {"generation": gen, "level": level, "tokens": n, "buckets": k, "merged": merged, "seconds": time.time() - began}
            if self.on_compaction:
                self.on_compaction(event)
            return event

    @staticmethod
    def vectors(postings: DataFrame, centroids: DataFrame) -> DataFrame:
        """Postings with vec, the centre plus the decoded residual."""
        near = postings.join(centroids.select("gen", "bucket", "center"), ["gen", "bucket"])
        return near.withColumn("vec", add("center", decode_levels("levels"))).drop("center", "levels")

    def clear_index(self) -> None:
        """Drop generations; documents and chunks stay and count as orphaned until they are added again."""
        self._open()
        with self.lock:
            none = {x: self.tables.read(x).where(F.lit(False)) for x in ("generations", "centroids", "postings", "pending")}
            self.tables.commit(**none)

    # -- search

    def search(self, query: str, top: int = 10, *, filter: Filter = All(), deadline: float | None = None) -> SearchResult:
        """Hybrid hits by reciprocal rank fusion; text only if the query has no tokens, vectors only if it has no terms."""
        self._open()
        c, seconds, began = self.search_config, {}, time.perf_counter()
        limit = c.deadline if deadline is None else deadline

        def stage(name: str) -> None:
            nonlocal began
            now = time.perf_counter()
            seconds[name] = now - began
            began = now
            if sum(seconds.values()) > limit:
                raise SearchTimeout(f"over {limit} s after {name}")

        if top <= 0:
            return SearchResult([], seconds)
        if self.tables.read("pending").head(1):
            self.index()
        stage("flush")
        q = self.embedder.encode_query(query)
        stage("embed")
        words = textsearch.query_terms(query)
        if not len(q) and not words:
            return SearchResult([], seconds)
        docs = apply(self.tables.read("documents"), filter)
        none = self.spark.createDataFrame([], "uuid string, score double")
        vector = self.vector_hits(q, docs) if len(q) else none
        text = textsearch.bm25(self.tables.read("documents"), query, title_weight=c.title_weight, match=c.match).join(docs.select("uuid"), "uuid", "left_semi") if words else none
        tag = f"search-{id(seconds)}"
        self.spark.sparkContext.addJobTag(tag)
        timer = threading.Timer(max(0.0, limit - sum(seconds.values())), lambda: self.spark.sparkContext.cancelJobsWithTag(tag))
        timer.start()
        try:
            hits = [r.asDict() for r in ranking.fuse(vector, text, top=top, budget=c.budget, k=c.rrf_k).collect()]
        except Exception as e:
            if "cancel" in str(e).lower():
                raise SearchTimeout(f"over {limit} s while searching") from e
            raise
        finally:
            timer.cancel()
            self.spark.sparkContext.removeJobTag(tag)
        seconds["search"] = time.perf_counter() - began
        return SearchResult(hits, seconds)

    def vector_hits(self, q, docs: DataFrame) -> DataFrame:
        """(uuid, score) of documents by pruned MaxSim; the filter applies after candidates are chosen."""
        query = self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "q int, qvec array<double>")
        centroids = self.tables.read("centroids")
        c = self.search_config
        selected = maxsim.select_centroids(maxsim.distinct_tokens(query), centroids, k=c.k, token_budget=c.token_budget).select("gen", "bucket").distinct()
        chosen = self.tables.read("postings").join(F.broadcast(selected), ["gen", "bucket"], "left_semi")
        chunks = self.tables.read("chunks").select(F.col("id").alias("chunk_id"), "hash")
        postings = self.vectors(chosen, centroids).join(chunks, "chunk_id").select("gen", "bucket", F.col("hash").alias("doc"), "vec")
        scored = maxsim.pruned(query, centroids, postings, k=c.k, token_budget=c.token_budget, threshold=c.threshold)
        return scored.withColumnRenamed("doc", "hash").join(docs.select("uuid", "hash"), "hash").select("uuid", "score")

    def score(self, query: str, passages: list[str]) -> list[float]:
        """Exact MaxSim of passages that need not be in the store; 0 for an empty one."""
        self._open()
        q = self.embedder.encode(query)
        if not len(q) or not passages:
            return [0.0] * len(passages)
        query_rows = self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "q int, qvec array<double>")
        docs = self.spark.createDataFrame(list(enumerate(passages)), "doc int, text string")
        tokens = embed(docs, self.embedder, id="doc", text="text").select("doc", "vec")
        return [r.score for r in maxsim.passages(query_rows, tokens, docs).orderBy("doc").collect()]

    # -- maintenance

    def find_orphans(self) -> DataFrame:
        self._open()
        waiting = self.tables.read("pending").select("chunk_id").distinct()
        short = maintain.orphaned(self.tables.read("chunks"), self.tables.read("postings"), self.tables.read("documents"))
        return short.join(waiting, short["id"] == waiting["chunk_id"], "left_anti")

    def vacuum(self, most: int = 10_000) -> dict:
        """Drop chunks that no document owns, up to `most`, with their postings; then files that are no longer current."""
        self._open()
        with self.lock:
            self.index()
            chunks, docs, postings = (self.tables.read(x) for x in ("chunks", "documents", "postings"))
            batch = maintain.vacuum_batch(chunks, docs, most).persist()
            n = batch.count()
            left = batch.first().remaining if n else 0
            if n:
                kept = maintain.vacuum(postings, batch).persist()
                sizes = kept.groupBy("gen", "bucket").agg(F.count("*").alias("n"))
                centroids = self.tables.read("centroids").drop("n").join(sizes, ["gen", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
                ranges = lsm.chunk_ranges(kept)
                generations = self.tables.read("generations").select("gen", "level", "created").join(ranges, "gen")
                self.tables.commit(postings=kept, centroids=centroids.join(generations.select("gen"), "gen", "left_semi"), generations=generations, chunks=chunks.join(batch.select("id"), "id", "left_anti"))
                kept.unpersist()
            batch.unpersist()
            return {"chunks_removed": n, "remaining": left, "bytes_freed": self.tables.purge()}

    def recover(self) -> dict:
        """Resolve chunks that occur in several generations in favour of their winner."""
        self._open()
        with self.lock:
            postings, generations = self.tables.read("postings"), self.tables.read("generations")
            n = lsm.conflicts(postings).count()
            if n:
                kept = lsm.recovered(postings, generations).persist()
                sizes = kept.groupBy("gen", "bucket").agg(F.count("*").alias("n"))
                centroids = self.tables.read("centroids").drop("n").join(sizes, ["gen", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
                new = generations.select("gen", "level", "created").join(lsm.chunk_ranges(kept), "gen")
                self.tables.commit(postings=kept, generations=new, centroids=centroids.join(new.select("gen"), "gen", "left_semi"))
                kept.unpersist()
            return {"conflicts": n}

    def checkpoint(self) -> str:
        """Every commit is complete, so there is never a part left to write."""
        self._open()
        self.index()
        return "complete"

    def shutdown(self) -> None:
        if self.closed:
            raise AlreadyShutDown("the store is shut down")
        self.index()
        self.closed = True
