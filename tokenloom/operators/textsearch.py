"""Full-text search: BM25 with a weighted title, and the plain overlap score."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import TERM, terms

K1, B = 1.2, 0.75


def query_terms(query: str) -> list[str]:
    import regex

    return [t.lower() for t in regex.findall(TERM[1:-1], query)]


def bm25(docs: DataFrame, query: str, *, title_weight: float = 3.0, match: str = "all") -> DataFrame:
    """docs (uuid, title, body) -> (uuid, score) of the matching ones.

    Corpus statistics come from all of docs. match="all" wants every query term,
    "any" at least one; a term that repeats in the query counts as often. Only
    the few query terms are counted per document, in one pass, so no inverted
    index is shuffled; the statistics are one aggregate row joined back.
    """
    wanted = Counter(query_terms(query))
    if not wanted:
        return docs.select("uuid", F.lit(0.0).alias("score")).where(F.lit(False))
    cut = docs.select("uuid", *[terms(F.coalesce(c, F.lit(""))).alias(c) for c in ("title", "body")])
    tf = lambda c, term: F.size(F.filter(c, lambda x: x == term))
    names = list(wanted)
    counts = F.struct((F.size("title") + F.size("body")).alias("len"), *[(title_weight * tf("title", t) + tf("body", t)).alias(f"f{i}") for i, t in enumerate(names)])
    # A generator of one row: the filter below would otherwise be pushed down and cut the texts again for each term.
    counted = cut.select("uuid", F.inline(F.array(counts)))
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"n{i}") for i in range(len(names))])
    score = F.lit(0.0)
    for i, t in enumerate(names):
        raw = F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(raw > 0, raw).otherwise(1e-6)
        f = F.col(f"f{i}")
        score = score + wanted[t] * idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    hits = [F.col(f"f{i}") > 0 for i in range(len(names))]
    some = hits[0]
    for h in hits[1:]:
        some = some & h if match == "all" else some | h
    return counted.where(some).crossJoin(F.broadcast(stats)).select("uuid", score.alias("score"))  # stats: one row


def overlap(docs: DataFrame, query: str, *, title_weight: float = 3.0) -> DataFrame:
    """(uuid, score): share of query terms in the body, and weighted in the title, over the number of query terms; hits only."""
    words = query_terms(query)
    if not words:
        return docs.select("uuid", F.lit(0.0).alias("score")).where(F.lit(False))
    q = F.array(*map(F.lit, words))
    count = lambda col: F.size(F.filter(q, lambda t: F.array_contains(terms(F.coalesce(col, F.lit(""))), t)))
    score = (count("body") + title_weight * count("title")) / len(words)
    return docs.select("uuid", score.alias("score")).where("score > 0")
